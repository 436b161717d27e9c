"""Updates by alignments, graphs and records, and exports and views, on small hand-made files."""

import os

import pytest

from strandwork.functions.scalars import file_type
from strandwork.operators import bubbles
from strandwork.operators import graphs as G
from strandwork.repository import Repository
from strandwork.sources import readers
from tests.test_repository import GFA, HEAD, REF, files, repo  # noqa: F401

CHANGED = "ATAAAAAAAATCGATCGATCGATCGGGAACACACAGAGA"
DIFF = "S\t3.2\tCGA\t*\nS\t4.0\tAAAAAAAA\t*\nS\t3.0\tAT\t*\nS\t3.5\tTCGATCGATCGATCGGGAACACACAGAGA\t*\nL\t3.2\t+\t3.5\t+\t0M\nL\t3.0\t+\t4.0\t+\t0M\nL\t4.0\t+\t3.5\t+\t0M\nL\t3.0\t+\t3.2\t+\t0M\n"


def text_of(folder):
    return "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part"))


@pytest.mark.parametrize("lines", ["P\tM-123\t3.0+,3.2+,3.5+\t*\nP\tother\t3.0+,4.0+,3.5+\t*\n", "W\tm123\t0\t123\t0\t100\t>3.0>3.2>3.5\t*\nW\tM-234\t0\tM-234\t0\t100\t>3.0>4.0>3.5\t*\n"])
def test_gfa_update(repo, files, lines):  # noqa: F811
    lone = "S\t9\tTTTT\t*\nP\talone\t9+\t*\n"
    assert repo.update_gfa(files("d.gfa", DIFF + lone + lines), "test", "applied diff") == {"alone": "no path that it shares segments with matches"}
    assert repo.all_sequences("test", "applied diff", prune=False) == {REF, CHANGED}
    assert repo.path_sequence("test", "applied diff", "m123") == CHANGED
    assert repo.all_sequences("test", None) == {REF}


def test_sample_diff_applies_to_the_first_sample(repo, spark, tmp_path, files):  # noqa: F811
    repo.update_fasta(files("a.fa", ">a\nAAAAAAAA\n"), "test", "child", "m123", 2, 5)
    out = str(tmp_path / "diff")
    repo.export_sample_diff(out, "test", None, "child")
    rows = [line.split("\t") for line in text_of(out).splitlines()]
    assert sorted(r[2] for r in rows if r[0] == "S") == sorted(["AT", "CGA", "AAAAAAAA", REF[5:]])
    assert sum(r[0] == "L" for r in rows) == 4 and len([r for r in rows if r[0] == "P"]) == 2
    other = Repository(spark, "file://" + str(tmp_path / "other"))
    other.import_gfa(out, "again", name="x")
    assert other.all_sequences("again", None, prune=False) == {REF, CHANGED}
    repo.update_gfa(out, "test", "by diff")
    assert repo.all_sequences("test", "by diff", prune=False) == {REF, CHANGED}


def genbank(name, sequence, *features):
    rows = [f"LOCUS       {name:<16} {len(sequence):>11} bp    DNA     linear   UNK", "FEATURES             Location/Qualifiers", f"     source          1..{len(sequence)}"]
    for where, kind, old in features:
        rows += [f"     misc_feature    {where}", f'                     /note="Geneious type: Editing History {kind}"', f'                     /Original_Bases="{old}"']
    rows.append("ORIGIN")
    rows += [f"{k + 1:>9} {sequence[k : k + 10]}" for k in range(0, len(sequence), 10)]
    return "\n".join([*rows, "//"]) + "\n"


EDITED = REF[:4] + "TTTT" + REF[4:10] + "GG" + REF[13:20] + REF[25:]
EDITS = [("5..8", "Insertion", ""), ("15..16", "Replacement", REF[10:13]), ("23^24", "Deletion", REF[20:25])]


def test_genbank_round_trip(spark, tmp_path, files):  # noqa: F811
    r = Repository(spark, "file://" + str(tmp_path / "r"))
    r.import_genbank(files("e.gb", genbank("seq1", EDITED, *EDITS)), "test")
    every = {a + REF[4:10] + b + REF[13:20] + c + REF[25:] for a in (REF[:4], REF[:4] + "TTTT") for b in (REF[10:13], "GG") for c in (REF[20:25], "")}
    assert r.all_sequences("test", None, prune=False) == every and r.path_sequence("test", None, "seq1") == REF
    out = str(tmp_path / "out")
    r.export_genbank(out, "test")
    got = readers.genbank(spark, out).collect()
    assert [(g.name, g.kind, g.sequence) for g in got] == [("seq1", "DNA", EDITED)]
    assert [(e.start, e.end, e.old, e.type) for e in got[0].edits] == [(4, 8, "", "insertion"), (14, 16, REF[10:13], "replacement"), (23, 23, REF[20:25], "deletion")]
    again = Repository(spark, "file://" + str(tmp_path / "s"))
    again.import_genbank(out, "test")
    assert again.all_sequences("test", None, prune=False) == every


def test_genbank_update(spark, tmp_path, files):  # noqa: F811
    r = Repository(spark, "file://" + str(tmp_path / "r"))
    plain, more = files("p.gb", genbank("seq1", REF)), files("m.gb", genbank("seq1", REF[:4] + "TTTT" + REF[4:], EDITS[0]) + genbank("seq2", "ACGTACGT"))
    r.import_genbank(plain, "test")
    with pytest.raises(ValueError, match="seq2"):
        r.update_genbank(more, "test")
    r.update_genbank(more, "test", create_missing=True)
    assert r.all_sequences("test", None, "seq1", prune=False) == {REF, REF[:4] + "TTTT" + REF[4:]}
    assert r.all_sequences("test", None, "seq2") == {"ACGTACGT"}
    with pytest.raises(ValueError, match="molecule"):
        r.update_genbank(files("n.gb", "LOCUS       x\nORIGIN\n        1 acgt\n//\n"), "test")


def test_ways_around():
    links = [(1, 2), (2, 3), (3, 4), (2, 9), (9, 4), (3, 8), (8, 8), (1, 7), (7, 6)]
    assert bubbles.ways_around(links, [1, 2, 3, 4]) == [(1, 3, [9])]


def test_gaf_update(spark, tmp_path, files):  # noqa: F811
    r = Repository(spark, "file://" + str(tmp_path / "r"))
    r.import_gfa(files("s.gfa", "H\tVN:Z:1.0\nS\t1\tATCGATCGATCGATCGA\nS\t2\tTCGGGAACACACAGAGA\nL\t1\t+\t2\t+\t0M\nP\tm123\t1+,2+\t*\n"), "test", name="m123")
    ids = {x.sequence: x.node_id for x in r.node_sequences().collect()}
    a, b = ids["ATCGATCGATCGATCGA"], ids["TCGGGAACACACAGAGA"]
    csv = files("c.csv", "id,left,sequence,right\nmid,ATCGATCGATCGATCGATC,GGG,GAACACA\nfirst,,CCC,ATCG\n,GAGA,TTT,\nunused,AA,AA,AA\n")
    row = lambda q, path, start, matches: f"{q}\t9\t0\t9\t+\t{path}\t34\t{start}\t30\t{matches}\t9\t60\ttp:A:P\tcg:Z:9M\n"
    gaf = row("mid_left", f">{a}.0>{b}.0", 0, 19) + row("mid_right", f">{b}.0", 4, 7) + row("first_right", f">{a}.0", 0, 4) + row("_gen_2_left", f">{a}.0.17>{b}.0.17", 13, 34) + row("mid_left", f">{a}.0", 0, 3) + row("other_left", f">{a}.0", 0, 3)
    r.update_gaf(files("x.gaf", gaf), csv, "test", "child")
    spelled = r.all_sequences("test", "child", prune=False)
    whole = "ATCGATCGATCGATCGATCGGGAACACACAGAGA"
    changed = whole[:19] + "GGG" + whole[21:]
    assert spelled == {a + changed + b for a in ("", "CCC") for b in ("", "TTT")}  # an alignment's cuts are not healed
    assert r.all_sequences("test", None) == {whole}
    with pytest.raises(ValueError, match="no place"):
        r.update_gaf(files("y.gaf", row("mid_left", f">{a}.0", 0, 3)), csv, "test", "again")


def test_shallow_import_reads_slices(spark, tmp_path, files):  # noqa: F811
    wide = REF * 3
    fasta = files("w.fa", ">one\n" + "".join(wide[k : k + 10] + "\n" for k in range(0, len(wide), 10)) + ">two\nACGT\n")
    for name, index in (("plain", None), ("indexed", f"one\t{len(wide)}\t5\t10\t11\ntwo\t4\t{5 + len(wide) + -(-len(wide) // 10) + 5}\t4\t5\n")):
        if index:
            files("w.fa.fai", index)
        r = Repository(spark, "file://" + str(tmp_path / name))
        r.import_fasta(fasta, "test", shallow=True)
        assert {(x.name, x.sequence, x.length) for x in r.table("sequences").collect()} == {("one", "", len(wide)), ("two", "", 4)}
        assert r.path_sequence("test", None, "one", 7, 45) == wide[7:45] and r.path_sequence("test", None, "two") == "ACGT"
        wanted = spark.createDataFrame([("one", 0, 3, 1), ("one", 8, 12, 2), ("one", 95, 500, 3), ("two", 1, 3, 4), ("one", 20, 50, 5)], "name string, start long, end long, k long")
        got = {x.k: x.sequence for x in readers.fasta_slices(spark, fasta, wanted).collect()}
        assert got == {1: wide[:3], 2: wide[8:12], 3: wide[95:], 4: "CG", 5: wide[20:50]}


def test_path_slices_on_both_strands(spark, tmp_path, files):  # noqa: F811
    r = Repository(spark, "file://" + str(tmp_path / "r"))
    r.import_gfa(files("r.gfa", "S\t1\tAACC\nS\t2\tGGTT\nL\t1\t-\t2\t+\t*\nP\tp\t1-,2+\t*\n"), "test", name="x")
    assert r.path_sequence("test", None, "x") == "GGTTGGTT"
    assert [r.path_sequence("test", None, "x", a, b) for a, b in ((1, 3), (3, 6), (None, 2), (6, None))] == ["GT", "TGG", "GG", "TT"]


def test_subgraph_and_accessions(repo, files):  # noqa: F811
    repo.update_vcf(files("v.vcf", HEAD.format("G1") + "m123\t3\t.\tCG\tC\t9\t.\tGAN=del1;GAA=1\tGT\t0/1\n"), "test")
    assert {(x.name, x.path_id is not None) for x in repo.table("accessions").collect()} == {("del1", True)}
    repo.derive_subgraph("test", "part", "m123", 1, 12, parent="G1")
    assert repo.all_sequences("test", "part", prune=False) == {REF[1:12], REF[1:3] + REF[4:12]}
    assert repo.path_sequence("test", "part", "m123") == REF[1:12]
    repo.update_fasta(files("a.fa", ">a\nAA\n"), "test", "grandchild", "m123", 20, 22, parent="G1")
    named = repo.accession_blocks("del1").collect()
    assert len({x.path_id for x in named}) == 2  # the clone has the accession too
    with pytest.raises(ValueError, match="outside"):
        repo.derive_chunks("test", "none", "m123", [(30, 60)])


def test_operations_and_remote(repo, spark, tmp_path, files):  # noqa: F811
    first = repo.head()
    repo.set_summary(first, "the beginning")
    repo.set_defaults(collection="test")
    assert [tuple(r) for r in repo.operation_files(first).collect()] == [(str(tmp_path / "simple.fa"), "fasta")]
    remote = "file://" + str(tmp_path / "remote")
    assert repo.push(remote) == [first] and repo.push(remote) == []
    there = Repository(spark, remote)
    assert there.all_sequences("test", None) == {REF} and there.operation(first)["summary"] == "the beginning"
    there.import_fasta(files("o.fa", ">o\nAC\n"), "test")
    with pytest.raises(ValueError, match="ahead"):
        repo.push(remote)
    with pytest.raises(ValueError):
        repo.push("https://example.org/x")
    stale = Repository(spark, repo.root)
    repo.set_summary(first, "again")
    with pytest.raises(RuntimeError, match="another writer"):
        stale.set_summary(first, "lost")
    os.makedirs(tmp_path / "home" / "a" / "b")
    mine = Repository(spark, "file://" + str(tmp_path / "home" / ".strandwork"))
    assert Repository.find(spark, "file://" + str(tmp_path / "home" / "a" / "b")).log == mine.log
    with pytest.raises(FileNotFoundError):
        Repository.find(spark, "file://" + str(tmp_path / "remote"))


def test_views_of_an_operation(repo, files, tmp_path):  # noqa: F811
    op = repo.update_fasta(files("a.fa", ">a\nAAAAAAAA\n"), "test", "child", "m123", 2, 5)
    new = repo.node_sequences().where("sequence = 'AAAAAAAA'").first().node_id
    made = [r for r in repo.change_graph(op).collect() if r.made and new in (r.source_node_id, r.target_node_id)]
    assert {(r.source_end, r.target_start) for r in made} == {(2, 0), (8, 5)}
    repo.export_dot(op, str(tmp_path / "dot"))
    folders = [f for f in os.listdir(tmp_path / "dot") if f.startswith("block_group_id")]
    text = text_of(str(tmp_path / "dot" / folders[0]))
    assert text.startswith("digraph") and "AAA...AAA" in text and "style=dashed" in text
    held = repo.to_dict("test", "child", "m123")
    assert {v["sequence"] for v in held["nodes"].values()} >= {"AT", "CGA", "AAAAAAAA", REF[5:]}
    assert all(layers for layers in held["edges"].values())
    assert repo.sample_graph("test", "child").count() == len(held["edges"])


def test_annotation_files(repo, files, tmp_path):  # noqa: F811
    repo.update_vcf(files("v.vcf", HEAD.format("foo") + "m123\t3\t.\tCG\tC\t9\t.\t.\tGT\t1/1\n"), "test")
    gff = files("s.gff", "##gff-version 3\nm123\tsrc\tGene\t2\t10\t.\t+\t.\tID=g\n")
    rows = sorted((r.start, r.end, r.type, r.attributes) for r in repo.translate_gff(gff, "test", "foo").collect())
    assert rows == [(2, 3, "Gene", "ID=g"), (4, 4, "Gene", "ID=g"), (5, 10, "Gene", "ID=g")]
    repo.write_annotations(repo.translate_gff(gff, "test", "foo"), str(tmp_path / "gff"))
    assert [line.split("\t")[1:5] for line in text_of(str(tmp_path / "gff")).splitlines()] == [["src", "Gene", "2", "3"], ["src", "Gene", "4", "4"], ["src", "Gene", "5", "10"]]
    bed = files("s.bed", "m123\t1\t10\tabc\n")
    repo.write_annotations(repo.translate_bed(bed, "test", "foo"), str(tmp_path / "bed"))
    assert [line.split("\t")[1:] for line in text_of(str(tmp_path / "bed")).splitlines()] == [["1", "3", "abc"], ["3", "4", "abc"], ["4", "10", "abc"]]


def test_gfa_reader(spark, files):  # noqa: F811
    gfa = readers.Gfa(spark, files("g.gfa", GFA + "S\t70000\tA\nS\t200001\tC\nP\tg1#1#c1\t1+\t*\nP\tg1#1#c2\t1+\t*\nP\tg1#2#c1\t1+\t*\n"))
    assert [(r["first"], r["last"]) for r in gfa.gaps().orderBy("first").collect()] == [(5, 69999), (70001, 200000)]
    assert gfa.ids_are_numbers() and not gfa.ids_are_compact()
    assert readers.Gfa(spark, files("h.gfa", GFA)).ids_are_compact() and gfa.version() == 1.2
    assert {(r.genome, r.haplotype, tuple(r.contigs)) for r in gfa.haplotypes().collect()} == {("g1", "1", ("c1", "c2")), ("g1", "2", ("c1",))}


def test_links_of_paths_and_layout(spark):
    pairs = [(1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (4, 3)]
    block = lambda n: (n, 0, 0 if n in (1, 2) else 9)
    name = {1: 1, 2: 3, 3: 4, 4: 6, 5: 2}
    df = spark.createDataFrame([(7, *block(name[a]), *block(name[b])) for a, b in pairs], "block_group_id long, " + ", ".join(f"{c} long" for c in [*G.SOURCE, *G.TARGET]))
    links = {}
    for r in G.enumerated_links(df).collect():
        links.setdefault(r.path, []).append((r.step, r.source_node_id, r.target_node_id))
    assert sorted([b for _, _, b in sorted(v)] for v in links.values()) == [[3, 4, 2], [3, 6, 2], [3, 6, 4, 2]]
    assert {(r.node_id, r.layer, r.row) for r in G.layout(df).collect()} == {(1, 0, 0), (3, 1, 0), (6, 2, 0), (4, 3, 0), (2, 4, 0)}


def test_file_types():
    assert [file_type(x) for x in ("a/b.fa.gz", "x.GB", "y.gfa", "z.txt", "v.vcf.bgz")] == ["fasta", "gb", "gfa", "none", "vcf"]
