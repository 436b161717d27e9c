"""Files that arrive in a folder become operations, each once."""

from strandwork.streaming.follow import follow_vcf
from tests.test_repository import HEAD, REF, files, repo  # noqa: F401


def test_follow_vcf(repo, tmp_path):  # noqa: F811
    folder = tmp_path / "calls"
    folder.mkdir()
    write = lambda name, sample, pos, ref, alt: (folder / name).write_text(HEAD.format(sample) + f"m123\t{pos}\t.\t{ref}\t{alt}\t9\t.\t.\tGT\t1/1\n")
    go = lambda: follow_vcf(repo, "file://" + str(folder), "test", "file://" + str(tmp_path / "seen")).awaitTermination()
    write("a.vcf", "G1", 3, "CG", "C")
    (folder / "note.txt").write_text("no variants")
    go()
    assert repo.all_sequences("test", "G1") == {REF[:3] + REF[4:]} and len(repo.history()) == 2
    go()
    assert len(repo.history()) == 2
    write("b.vcf", "G2", 5, "C", "T")
    go()
    assert len(repo.history()) == 3 and repo.all_sequences("test", "G2") == {REF[:4] + "T" + REF[5:]}
