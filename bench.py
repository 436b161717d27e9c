"""Wall-clock seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "path_sequence", "path_blocks", "block_split", "graph_assemble", "prune_edges", "overlap_blocks", "point_in_block",
    "block_mappings", "change_to_edges", "library_edges", "stitch_edges", "upsert_edges_ordered", "seq_dedupe", "propagate_annotations", "gfa_lines",
]


#: Letters of the sequence and records of the variant file that the flows are timed on.
LETTERS, RECORDS = 50_000_000, 100_000


def flows(spark) -> dict[str, float]:
    """Seconds of an import of a chromosome's size, whole and without its sequence, and of an update by 100,000 variants of one sample."""
    import shutil
    import tempfile

    import numpy as np

    from strandwork.repository import Repository

    folder = tempfile.mkdtemp(prefix="strandwork-bench-")
    try:
        rng = np.random.default_rng(1)
        letters = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, LETTERS)]
        wide = letters.reshape(-1, 50)
        with open(f"{folder}/chr.fa", "wb") as f:
            f.write(b">chr22\n" + np.hstack([wide, np.full((len(wide), 1), 10, np.uint8)]).tobytes())
        with open(f"{folder}/chr.fa.fai", "w") as f:
            f.write(f"chr22\t{LETTERS}\t7\t50\t51\n")
        at = np.sort(rng.choice(LETTERS - 2, RECORDS, replace=False)) + 1
        text = letters.tobytes().decode()
        other = {"A": "C", "C": "G", "G": "T", "T": "A"}
        with open(f"{folder}/calls.vcf", "w") as f:
            f.write("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tHG1\n")
            f.writelines(f"chr22\t{p}\t.\t{text[p - 1]}\t{other[text[p - 1]]}\t9\tPASS\t.\tGT\t0|1\n" for p in at.tolist())
        out = {}
        for name, shallow in (("import_shallow", True), ("import_full", False)):
            repo = Repository(spark, f"file://{folder}/{name}")
            began = time.time()
            repo.import_fasta(f"{folder}/chr.fa", "bench", shallow=shallow)
            out[name] = round(time.time() - began, 3)
        began = time.time()
        repo.update_vcf(f"{folder}/calls.vcf", "bench")
        out["vcf_100k"] = round(time.time() - began, 3)
        return out
    finally:
        shutil.rmtree(folder)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    from pyspark.sql import SparkSession

    from strandwork import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    found = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    found |= flows(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
