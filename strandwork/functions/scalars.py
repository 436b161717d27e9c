"""Scalar functions of sequences, variants, strands and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.schema import END_NODE, FILE_KINDS, START_NODE


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def text_hash(x) -> Column:
    return F.sha2(_c(x), 256)


def sequence_hash(kind, sequence, name=None, file_path=None) -> Column:
    """Identity of a sequence: its parts, each followed by a semicolon, a missing one empty."""
    parts = []
    for p in (kind, sequence, name, file_path):
        parts += [F.lit("") if p is None else F.coalesce(_c(p), F.lit("")), F.lit(";")]
    return F.sha2(F.concat(*parts), 256)


def node_hash(scheme: str, **part) -> Column:
    """Identity of a node by the way it came in."""
    p = {k: _c(v).cast("string") for k, v in part.items()}
    arrow = lambda: F.concat(p["start"], F.lit("-"), p["end"], F.lit("->"), p["hash"])
    made = {
        "import": lambda: F.concat(p["collection"], F.lit("."), p["name"], F.lit(":"), p["hash"]),
        "variant": lambda: F.concat(p["path"], F.lit(":"), arrow()),
        "library": lambda: F.concat(p["path"], F.lit(":"), arrow(), F.lit("-column-"), p["column"]),
        "library_import": lambda: F.concat(p["region"], F.lit(":"), p["part"], F.lit(":"), arrow(), F.lit("-column-"), p["column"]),
        "edit": lambda: F.concat(p["wild_type"], F.lit(":"), arrow()),
        "graph": lambda: F.concat_ws("_", p["path"], p["segment"], p["hash"]),
    }[scheme]()
    return F.sha2(made, 256)


def derived_node_hash(collection, sample, old_hash, block_group) -> Column:
    return F.concat(_c(collection), F.lit("."), _c(sample), F.lit("."), _c(old_hash), F.lit(".bg-"), _c(block_group).cast("string"))


def reverse_complement(x) -> Column:
    """Case stays, N stays; letters other than ACGTN are no DNA and give null."""
    c = _c(x)
    return F.when(c.rlike("^[ACGTNacgtn]*$"), F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca")))


def spelled(sequence, strand) -> Column:
    return F.when(_c(strand) == "-", F.reverse(F.translate(_c(sequence), "ACGTacgt", "TGCAtgca"))).otherwise(_c(sequence))


def slice_of(sequence, start=None, end=None) -> Column:
    """[start, end) of a sequence; the whole where they are not given."""
    s = _c(sequence)
    a = F.lit(0) if start is None else _c(start)
    b = F.length(s) if end is None else _c(end)
    return s.substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def without_whitespace(x) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s", "")


def genotype(x) -> Column:
    """array<struct<allele, phased>> of a VCF genotype: an allele's phase is the sign before it.

    The first allele is phased unless the text holds a slash; a dot gives a null.
    """
    g = _c(x)
    alleles = F.split(g, r"[/|]")
    signs = F.concat(F.array(F.when(F.contains(g, F.lit("/")), F.lit("/")).otherwise(F.lit("|"))), F.regexp_extract_all(g, F.lit(r"([/|])"), F.lit(1)))
    return F.zip_with(
        alleles,
        signs,
        lambda a, s: F.when(
            a.rlike("^[0-9]+$"),
            F.struct(a.cast("long").alias("allele"), (s == "|").cast("long").alias("phased")),
        ),
    )


def overlap_flags(a, b, x, y) -> Column:
    """(holds the start, holds the end, overlaps) of [a, b) against [x, y)."""
    a, b, x, y = map(_c, (a, b, x, y))
    holds_start, holds_end = (a <= x) & (x < b), (a <= y) & (y < b)
    return F.struct(holds_start.alias("contains_start"), holds_end.alias("contains_end"), ((a < y) & (x < b)).alias("overlap"))


def copy_number_allele(alt, reference) -> Column:
    """<CNk> is the reference k times; any other allele stays."""
    k = F.regexp_extract(_c(alt), r"^<CN(\d+)>$", 1)
    return F.when(k != "", F.repeat(_c(reference), k.cast("int"))).otherwise(_c(alt))


def trimmed_allele(start, reference, alt) -> Column:
    """struct<start, alt>: an allele of another length than the reference loses its first letter."""
    s, r, a = _c(start), _c(reference), _c(alt)
    cut = (a != "") & (a != "*") & (F.length(a) != F.length(r)) & ~a.rlike(r"^<CN\d+>$")
    return F.struct(F.when(cut, s + 1).otherwise(s).alias("start"), F.when(cut, a.substr(F.lit(2), F.length(a))).otherwise(a).alias("alt"))


def strands_fit(a, b) -> Column:
    """A dot or a question mark fits any strand."""
    a, b = _c(a), _c(b)
    return a.isin(".", "?") | b.isin(".", "?") | (a == b)


def strand_of(forward) -> Column:
    return F.when(_c(forward), F.lit("+")).otherwise(F.lit("-"))


def segment_id(node, start, end) -> Column:
    return F.concat_ws(".", _c(node).cast("string"), _c(start).cast("string"), _c(end).cast("string"))


def train_case(x) -> Column:
    """Words, cut at signs, at a change from lower to upper case and between letters and digits, capitalised and joined by hyphens."""
    s = F.regexp_replace(_c(x), r"[^\p{L}\p{N}]+", "-")
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        s = F.regexp_replace(s, pattern, "$1-$2")
    words = F.filter(F.split(s, "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "-")


def is_terminal(node) -> Column:
    return _c(node).isin(START_NODE, END_NODE)


def normal_collection(x) -> Column:
    """A collection's name without slashes at its ends and without doubled ones."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"/+", "/"), r"^/|/$", "")


def collection_basename(x) -> Column:
    return F.element_at(F.split(normal_collection(x), "/"), -1)


def collection_parent(x) -> Column:
    n = normal_collection(x)
    return F.when(F.contains(n, F.lit("/")), F.regexp_replace(n, r"/[^/]*$", "")).otherwise(F.lit(""))


def short_label(x, most: int = 7) -> Column:
    """A label of more letters than ``most`` as its first and last three."""
    c = _c(x)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, 3), F.lit("..."), F.right(c, F.lit(3))))


def inner_truncation(x, most: int) -> Column:
    """A label cut in its middle to ``most`` letters, with one ellipsis."""
    c, left = _c(x), (most - 1) - (most - 1) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, left), F.lit("…"), F.right(c, F.lit((most - 1) // 2))))


def file_type(path: str) -> str:
    """The kind of a file by its name; packed files go by the name before."""
    name = path.lower()
    for packed in (".gz", ".bgz", ".bgzf"):
        name = name.removesuffix(packed)
    return FILE_KINDS.get(name.rpartition(".")[2], "none")
