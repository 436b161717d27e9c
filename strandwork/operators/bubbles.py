"""Ways around a path, and records that show a path with its edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators.graphs import END, SOURCE, START, TARGET, links_of, successors
from strandwork.schema import END_NODE, START_NODE

FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def ways_around(links: list, walk: list) -> list[tuple[int, int, list]]:
    """(i, j, blocks): blocks that lead from walk[i] to walk[j] off the walk, by i; of ways that overlap the first stays.

    walk begins with the start block and ends with the end block. A way is followed along first successors; one that
    ends nowhere or comes back before it left is no way.
    """
    nxt, place, out = successors(links), {b: k for k, b in enumerate(walk)}, []
    for i, block in enumerate(walk[:-1]):
        for b in nxt.get(block, ()):
            if b == walk[i + 1]:
                continue
            way, seen = [], set()
            while b is not None and b not in place and b not in seen:
                seen.add(b)
                way.append(b)
                b = next(iter(nxt.get(b, ())), None)
            if b in place and place[b] > i:
                out.append((i, place[b], way))
    kept: list[tuple[int, int, list]] = []
    for found in sorted(out, key=lambda w: (w[0], w[1], w[2])):
        if not kept or found[0] >= kept[-1][1]:
            kept.append(found)
    return kept


def record(name: str, pieces: list[str], edits: list[tuple[int, int, str]]) -> str:
    """A GenBank record of pieces with edits (i, j, text): what lies between pieces i and j gives way to the text."""
    done, at, features = "", 0, []
    for i, j, new in edits:
        done += "".join(pieces[at : i + 1])
        old, here = "".join(pieces[i + 1 : j]), len(done)
        kind = "Replacement" if old and new else "Insertion" if new else "Deletion"
        where = f"{here + 1}..{here + len(new)}" if new else f"{here}^{here + 1}"
        features.append((where, kind, old))
        done += new
        at = j
    done += "".join(pieces[at:])
    lines = [f"LOCUS       {name:<16} {len(done):>11} bp    DNA     linear   UNK", "FEATURES             Location/Qualifiers"]
    for where, kind, old in features:
        lines.append(f"     {'misc_feature':<16}{where}")
        for key, value in (("note", f"Geneious type: Editing History {kind}"), ("Original_Bases", old)):
            text = f'/{key}="{value}"'
            lines += [" " * 21 + text[k : k + 58] for k in range(0, len(text), 58)] if key == "Original_Bases" else [" " * 21 + text]
    lines.append("ORIGIN")
    for k in range(0, len(done), 60):
        row = done[k : k + 60]
        lines.append(f"{k + 1:>9} " + " ".join(row[m : m + 10] for m in range(0, len(row), 10)))
    return "\n".join([*lines, "//"])


def genbank_records(links: DataFrame, walks: DataFrame, sequences: DataFrame, names: DataFrame, group: str = "block_group_id") -> DataFrame:
    """(name, line): a record for each group's path. links: block pairs; walks: (group, path_id, step, node_id, start, end, strand)."""
    text = sequences.select(F.col("node_id").alias("target_node_id"), "sequence")
    spelled = links.select(group, *SOURCE, *TARGET).join(text, "target_node_id", "left")
    slices = F.substring(F.coalesce("sequence", F.lit("")), (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    spelled = spelled.withColumn("text", slices).drop("sequence").join(names.withColumnRenamed("name", "graph"), group)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["name", "line"])
        name = left["graph"].iloc[0]
        texts = {tuple(b): t for b, t in zip(left[TARGET].to_numpy().tolist(), left["text"])}
        right = right.sort_values("step")
        inner = [(tuple(b), s) for b, s in zip(right[["node_id", "start", "end"]].to_numpy().tolist(), right["strand"]) if b[0] not in (START_NODE, END_NODE)]
        walk = [START, *[b for b, _ in inner], END]
        pieces = ["", *[texts[b][::-1].translate(FLIP) if s == "-" else texts[b] for b, s in inner], ""]
        edits = [(i, j, "".join(texts[b] for b in way)) for i, j, way in ways_around(links_of(left), walk)]
        edits = [e for e in edits if e[2] or any(pieces[e[0] + 1 : e[1]])]
        return pd.DataFrame({"name": [name], "line": [record(name, pieces, edits)]})

    return spelled.groupBy(group).cogroup(walks.groupBy(group)).applyInPandas(run, "name string, line string")
