"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups.

A leaf is the digest of a row's fields. In a group, leaves stand by id; every FAN consecutive nodes
of a level become the digest of their digests (lowercase hex, end to end; the last run may be
shorter), until one node remains, the group's subroot. The subroots, by group (null first, then by
UTF-8 bytes), are the leaves of one more such tree, whose last node is the root.

1. Leaves are sorted by range over (group, id). A row knows its rank in its partition; only a
   partition's first group may have begun before it, so one offset a partition makes ranks global.
2. A partition builds every complete aligned subtree of its rows, of FAN**HEIGHT leaves at most, and
   keeps the subtree's leaves with it as one row. At its ragged ends these are smaller, down to
   single leaves.
3. The tops of these subtrees are shuffled by coordinate (group, level, run), level by level, FAN at
   most meeting; a level is written out before the next. A row a run is 4096 times fewer than rows.
4. From the root down, each run gives its children their siblings and what lies above, until the tops
   have their paths; there the leaves are unfolded again with their whole proofs.

No task holds a group, and the driver holds an offset for each partition and the root. Rows are told
apart by place, so ids may repeat (then ordered by leaf) or be null (first). Null fields and empty
texts have digests of their own. An empty table has no root and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import broadcast_small, stored

FAN = 16
HEIGHT = 3  # levels that a partition builds
LEVELS = 15  # FAN ** LEVELS leaves are within a long
HEX = 64
UNFOLDED = 1024  # leaves in an Arrow batch of proofs
PROOF = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("siblings", T.StringType())]))
_ARROW_PROOF = pa.struct([("pos", pa.int32()), ("siblings", pa.string())])


def row_digest(*fields: str | Column) -> Column:
    """The digest of the fields end to end: `-` for null, else bytes in UTF-8, `:` and the value."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def _levels(leaves: bytes, height: int) -> list[bytes]:
    """Digests of each level end to end, from the leaves to the level `height`."""
    out, run = [leaves], FAN * HEX
    for _ in range(height):
        below = out[-1]
        out.append(b"".join(_digest(below[k : k + run]) for k in range(0, len(below), run)))
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """The rows (group, id, leaf, claim, tie) sorted by range, with `part`, the rank in the part's run
    of the group, and whether that is the part's first group."""
    order = ["group", "id", "leaf", "claim", "tie"]
    names = [*rows.columns, "part", "rank", "first"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, since, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(group.slice(1), group.slice(0, len(group) - 1)).to_numpy(zero_copy_only=False)
            new[0] = group[0].as_py() != last
            begin = np.flatnonzero(new)
            at = np.arange(len(new))
            run = np.searchsorted(begin, at, "right")
            rank = at - np.where(run > 0, begin[np.maximum(run - 1, 0)] if len(begin) else 0, -since)
            changes = run if last is not None else run - 1
            still = first & (changes == 0)
            first, last, since = bool(still[-1]), group[len(group) - 1].as_py(), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(rank.astype(np.int64)), pa.array(still)], names=names)

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part int, rank long, first boolean").fields])
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, schema)


def offsets(sorted_rows: DataFrame) -> dict[int, int]:
    """How many rows of each part's first group stand in parts before it: a number a part."""
    told = sorted_rows.groupBy("part").agg(F.sha1(F.min("group")).alias("lo"), F.sha1(F.max("group")).alias("hi"), (F.max_by("rank", F.struct("group", "rank")) + 1).alias("n"))
    out, open_group, before = {}, None, 0
    for r in sorted(told.collect()):
        out[r["part"]] = before if r["lo"] == open_group else 0
        before = r["n"] + (out[r["part"]] if r["lo"] == r["hi"] else 0)
        open_group = r["hi"]
    return out


def subtrees(sorted_rows: DataFrame, begin: dict[int, int], height: int = HEIGHT) -> DataFrame:
    """(group, level, idx, digest, ids, leaves, claims) of the complete aligned subtrees of the ranked rows."""
    names = ["group", "level", "idx", "digest", "ids", "leaves", "claims"]
    id_type = pa.int64() if sorted_rows.schema["id"].dataType == T.LongType() else pa.string()
    most = FAN**height

    def blocks(at: int, n: int) -> Iterator[tuple[int, int]]:
        """(level, size) of the largest aligned subtrees of n leaves from `at` on."""
        while n:
            level = 0
            while level < height and at % FAN ** (level + 1) == 0 and FAN ** (level + 1) <= n:
                level += 1
            yield level, FAN**level
            at, n = at + FAN**level, n - FAN**level

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        made: list[tuple] = []

        def build(run: pa.Table) -> None:
            group, at, done = run.column("group")[0].as_py(), run.column("index")[0].as_py(), 0
            ids, claims = run.column("id").to_pylist(), run.column("claim").to_pylist()
            leaves = "".join(run.column("leaf").to_pylist()).encode()
            for level, n in blocks(at, run.num_rows):
                mine = leaves[done * HEX : (done + n) * HEX]
                made.append((group, level, (at + done) // n, _levels(mine, level)[-1].decode(), ids[done : done + n], mine.decode(), claims[done : done + n]))
                done += n

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*made, strict=True)]
            made.clear()
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(id_type), pa.string(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            rank, first, part = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("rank", "first", "part"))
            index = rank + np.where(first, np.array([begin[p] for p in part.tolist()], np.int64), 0)
            rows = pa.Table.from_batches([batch]).select(["group", "id", "leaf", "claim"]).append_column("index", pa.array(index))
            rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
            if not rows.num_rows:
                continue
            group, index = rows.column("group").combine_chunks(), rows.column("index").to_numpy()
            cut = np.ones(len(index), bool)
            cut[1:] = pc.not_equal(group.slice(1), group.slice(0, len(index) - 1)).to_numpy(zero_copy_only=False) | (np.diff(index) != 1)
            edges = [*np.flatnonzero(cut).tolist(), len(index)]
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                build(rows.slice(a, b - a))
            # the last run may go on: its whole subtrees are built, the rest waits
            a, upto = edges[-2], int(index[-1]) + 1
            whole = upto // most * most - int(index[edges[-2]])
            if whole > 0:
                build(rows.slice(a, whole))
                a += whole
            kept = rows.slice(a)
            if made:
                yield out()
        if kept is not None and kept.num_rows:
            build(kept)
        if made:
            yield out()

    kind = sorted_rows.schema["id"].dataType.simpleString()
    return sorted_rows.mapInArrow(work, f"group string, level int, idx long, digest string, ids array<{kind}>, leaves string, claims array<string>")


@dataclass
class Forest:
    """The trees of all groups. tops: subtrees with their leaves; runs: by level, the runs of nodes
    above them; subroots: (group, depth, digest)."""

    tops: DataFrame
    runs: list[DataFrame]
    subroots: DataFrame

    def paths(self, above: DataFrame | None) -> DataFrame:
        """(group, level, idx, path, subroot) of the nodes of all levels; `above` has (group, path) of
        the groups in a tree over them."""
        start = self.subroots.select("group", "depth", F.col("digest").alias("subroot"))
        if above is None:
            start = start.withColumn("path", F.array().cast(PROOF))
        else:
            start = start.join(above.select("group", "path"), "group")
        at = lambda level: start.where(F.col("depth") == level).select("group", F.lit(0).cast("long").alias("idx"), "path", "subroot")
        here = stored(at(len(self.runs)), "paths")
        out = here.withColumn("level", F.lit(len(self.runs)))
        for level in range(len(self.runs) - 1, -1, -1):
            n = F.length("children") / HEX
            child = self.runs[level].select("group", "idx", "children").join(here, ["group", "idx"])
            child = child.select("*", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("k"))
            others = F.concat(F.substr("children", F.lit(1), F.col("k") * HEX), F.substr("children", (F.col("k") + 1) * HEX + 1))
            step = F.struct(F.col("k").cast("int").alias("pos"), others.alias("siblings"))
            below = child.select("group", (F.col("idx") * FAN + F.col("k")).alias("idx"), F.concat(F.array(step), F.col("path")).alias("path"), "subroot")
            here = stored(below.unionByName(at(level)), "paths")
            out = out.unionByName(here.withColumn("level", F.lit(level)))
        return out

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(group, id, leaf, claim, subroot, proof) of every leaf. A proof has, from the leaf up, the
        node's place in its run and the digests of the run's others end to end."""
        schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("id", self.tops.schema["ids"].dataType.elementType), *T.StructType.fromDDL("leaf string, claim string, subroot string").fields, T.StructField("proof", PROOF)])
        id_type = pa.int64() if schema["id"].dataType == T.LongType() else pa.string()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    levels = [x.decode() for x in _levels(r["leaves"].encode(), r["level"])]
                    upper = [(s["pos"], s["siblings"]) for s in r["path"]]
                    for lo in range(0, len(r["ids"]), UNFOLDED):
                        hi = min(lo + UNFOLDED, len(r["ids"]))
                        pos: list[int] = []
                        siblings: list[str] = []
                        for k in range(lo, hi):
                            for nodes in levels[:-1]:
                                k, own = divmod(k, FAN)
                                run = nodes[k * FAN * HEX : (k + 1) * FAN * HEX]
                                pos.append(own)
                                siblings.append(run[: own * HEX] + run[(own + 1) * HEX :])
                            for own, others in upper:
                                pos.append(own)
                                siblings.append(others)
                        n, each = hi - lo, len(levels) - 1 + len(upper)
                        steps = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(siblings, pa.string())], fields=list(_ARROW_PROOF))
                        proof = pa.ListArray.from_arrays(pa.array(np.arange(0, n * each + 1, max(each, 1), dtype=np.int32) if each else np.zeros(n + 1, np.int32)), steps)
                        leaves = [levels[0][k * HEX : (k + 1) * HEX] for k in range(lo, hi)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["group"]] * n), pa.array(r["ids"][lo:hi], id_type), pa.array(leaves), pa.array(r["claims"][lo:hi], pa.string()), pa.array([r["subroot"]] * n), proof], names=schema.names
                        )

        placed = self.tops.drop("digest").join(self.paths(above), ["group", "level", "idx"])
        return placed.select("group", "level", "ids", "leaves", "claims", "path", "subroot").mapInArrow(work, schema)


def forest(rows: DataFrame) -> Forest:
    """The trees of the rows (group, id, leaf, claim, tie)."""
    sorted_rows = stored(ranked(rows), "ranked")
    tops = stored(subtrees(sorted_rows, offsets(sorted_rows)), "subtrees")
    n = F.max(F.col("idx") * F.pow(F.lit(FAN), F.col("level")).cast("long") + F.size("ids"))
    sizes = tops.groupBy("group").agg(n.alias("n"))
    depth = sum(((F.col("n") > FAN**k).cast("int") for k in range(LEVELS)), F.lit(0))
    sizes = stored(sizes.select("group", depth.alias("depth")), "sizes")
    nodes = stored(tops.select("group", "level", "idx", "digest").join(broadcast_small(sizes), "group"), "nodes")
    runs: list[DataFrame] = []
    subroots = nodes.where("level = depth").select("group", "depth", "digest")
    for level in range(sizes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]):
        here = nodes.where(F.col("level") == level).select("group", "depth", "idx", "digest")
        if runs:
            here = here.unionByName(runs[-1].select("group", "depth", "idx", "digest"))
        met = here.where(F.col("depth") > level).groupBy("group", "depth", F.floor(F.col("idx") / FAN).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes"))
        met = met.select("group", "depth", "idx", F.array_join(F.col("nodes.digest"), "").alias("children"))
        runs.append(stored(met.withColumn("digest", F.sha2("children", 256)), "runs"))
        subroots = subroots.unionByName(runs[-1].where(F.col("depth") == level + 1).select("group", "depth", "digest"))
    return Forest(tops, runs, stored(subroots, "subroots"))


@dataclass
class Manifest:
    """root is None for an empty table. proofs: (group, id, leaf, claim, subroot, proof)."""

    root: str | None
    subroots: DataFrame
    proofs: DataFrame


def manifest(docs: DataFrame, group: str, id: str, leaf: Column, claim: Column | None = None) -> Manifest:
    """The manifest of the rows. `claim` is a digest to be held against the proof, null where there is
    none. Groups come back as `group`: an empty string for null, else `=` and the group's name."""
    kind = "long" if isinstance(docs.schema[id].dataType, (T.LongType, T.IntegerType)) else "string"
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    claim = F.lit(None).cast("string") if claim is None else claim
    rows = docs.select(name.alias("group"), F.col(id).cast(kind).alias("id"), leaf.alias("leaf"), claim.alias("claim"), F.monotonically_increasing_id().alias("tie"))
    inner = forest(stored(rows, "leaves"))
    none = F.lit(None).cast("string")
    outer = forest(inner.subroots.select(F.lit("").alias("group"), F.col("group").alias("id"), F.col("digest").alias("leaf"), none.alias("claim"), F.lit(0).cast("long").alias("tie")))
    root = outer.subroots.first()
    above = outer.proofs().select(F.col("id").alias("group"), F.col("proof").alias("path"))
    return Manifest(root["digest"] if root else None, inner.subroots.select("group", "digest"), inner.proofs(stored(above, "above")))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), s["pos"] * HEX), h, F.substr(s["siblings"], s["pos"] * HEX + 1)), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof end to end."""
    return F.array_join(F.transform(proof, lambda s: s["siblings"]), "")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of all documents; every fifth id (by crc32) claims the leaf of its text
    in lower case, and is verified only if that is the same."""
    upper = "".join(map(chr, range(65, 91)))
    lowered = [F.translate("text", upper, upper.lower()) if f == "text" else f for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = manifest(docs, "source", "doc_id", row_digest(*FIELDS), F.when(tampered, row_digest(*lowered)))
    root = F.lit(made.root).cast("string")
    out = made.proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
