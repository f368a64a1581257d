"""Mixing sources to target weights by tokens.

Weights run down a tree of columns (a source, its languages, ...). A node's
budget is shared among its children by weight; what a child can't give, its
siblings give before the node's own siblings do. Each leaf gives whole epochs
of its documents and a seeded prefix of one more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Most leaves of a tree; their totals come to the driver.
MAX_LEAVES = 100_000
#: Documents of a leaf that share a stretch of its shuffled order.
STRETCH = 5_000

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    """The tokenizer, read once by each worker."""
    if path not in _ENCODERS:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_tokens(df: DataFrame, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """df without its text, plus ``n_tokens``; 0 for null and empty texts."""
    keep = [c for c in df.columns if c not in (text_col, "n_tokens")]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")


def shared_out(budget: float, weights: Sequence[float], capacity: Sequence[float]) -> list[float]:
    """The budget by weight, no part over its capacity; what one lacks goes to the others by weight."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacity[i] > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + left * weights[i] / total >= capacity[i] - 1e-9]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= capacity[i] - out[i]
            out[i] = capacity[i]
        open_ = [i for i in open_ if i not in full]
        # the rest starts over from what each has
        left += sum(out[i] for i in open_)
        for i in open_:
            out[i] = 0.0
    return out


def budgets(leaves: list[dict], levels: Sequence[str], shares: dict, total: float) -> list[float]:
    """Tokens for each leaf. Top nodes weigh their share; below, children weigh their tokens."""
    out = [0.0] * len(leaves)

    def give(rows: list[int], depth: int, budget: float) -> None:
        if depth == len(levels):
            for i, x in zip(rows, shared_out(budget, [leaves[i]["tokens"] for i in rows], [leaves[i]["capacity"] for i in rows]), strict=True):
                out[i] = x
            return
        groups: dict = {}
        for i in rows:
            groups.setdefault(leaves[i][levels[depth]], []).append(i)
        keys = sorted(groups, key=str)
        tokens = [sum(leaves[i]["tokens"] for i in groups[k]) for k in keys]
        weights = [shares.get(k, 0.0) for k in keys] if depth == 0 else tokens
        room = [sum(leaves[i]["capacity"] for i in groups[k]) for k in keys]
        for k, x in zip(keys, shared_out(budget, weights, room), strict=True):
            give(groups[k], depth + 1, x)

    give(list(range(len(leaves))), 0, total)
    return out


def _plan(docs: DataFrame, weights: DataFrame, levels: Sequence[str], total: int | None) -> tuple[list[dict], dict]:
    leaves = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves; use fewer or coarser levels")
    given = {r["key"]: r for r in weights.limit(MAX_LEAVES + 1).collect() if r["key"] is not None}
    rows = []
    for r in sorted(leaves, key=lambda r: [str(r[c]) for c in levels]):
        repeats = max(0, given[r[levels[0]]]["max_repeats"] or 0) if r[levels[0]] in given else 0
        rows.append({c: r[c] for c in levels} | {"tokens": r["tokens"], "docs": r["docs"], "repeats": repeats, "capacity": float(r["tokens"] * repeats)})
    shares = {k: max(0.0, r["target_share"] or 0.0) for k, r in given.items()}
    if total is None:
        room: dict = {}
        for r in rows:
            room[r[levels[0]]] = room.get(r[levels[0]], 0.0) + r["capacity"]
        # the largest mixture in which every source reaches its share
        whole = sum(s for s in shares.values())
        total = min((room.get(k, 0.0) * whole / s for k, s in shares.items() if s > 0 and room.get(k, 0.0) > 0), default=0.0)
    for r, b in zip(rows, budgets(rows, levels, shares, float(total)), strict=True):
        epochs = min(r["repeats"], int((b + 1e-6) // r["tokens"])) if r["tokens"] else 0
        r |= {"budget": b, "epochs": epochs, "rest": b - epochs * r["tokens"] if epochs < r["repeats"] else 0.0}
    return rows, shares


def mixture(
    df: DataFrame,
    weights: DataFrame,
    *,
    id_col: str,
    text_col: str,
    source_col: str,
    below: Sequence[str] = (),
    share_col: str = "target_share",
    repeats_col: str = "max_repeats",
    total: int | None = None,
    seed: int = 1,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mixture, one row ``id``, ``source``, ``n_tokens``, ``n_used`` a used document; and its report.

    The report has a row for each source of weights: ``source``,
    ``target_share``, ``actual_share``, ``tokens``, ``documents``, ``most_used``
    and ``available``, its tokens once over. total: tokens of the mixture; if
    not given, the most for which every source that has documents reaches its
    share. Documents of no listed source (null too) and those without text give
    nothing; other null values of the tree's columns are a value of their own,
    told apart in lower case. Repeated rows are documents of their own; empty
    tables give an empty mixture and a report of zeros. Leaves take whole
    documents: the one that reaches a leaf's budget is taken if half of it fits.
    """
    levels = ["source", *[f"l{i}" for i in range(len(below))]]
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).alias("source"),
        *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"l{i}") for i, c in enumerate(below)],
        F.col(text_col).alias("text"),
    )
    keys = weights.select(F.col(source_col).alias("key"), F.col(share_col).cast("double").alias("target_share"), F.col(repeats_col).cast("int").alias("max_repeats"))
    docs = materialize(with_tokens(rows, "text", tokenizer), "tokens").where("n_tokens > 0")
    leaves, shares = _plan(docs, keys, levels, total)
    spark = df.sparkSession
    kind = ", ".join(f"{c} string" for c in levels)
    plan = spark.createDataFrame(
        [(*[r[c] for c in levels], r["epochs"], float(r["rest"]), max(1, r["docs"] // STRETCH)) for r in leaves if r["budget"] > 0], f"{kind}, epochs int, rest double, stretches long"
    )
    # bounded by MAX_LEAVES
    docs = docs.join(F.broadcast(plan), levels)
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "epochs", "id"))
    docs = docs.withColumn("at", F.pmod(F.shiftrightunsigned("h", 20), F.col("stretches")))
    sums = docs.where("rest > 0").groupBy(*levels, "at", "rest").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*levels).orderBy("at"))
    edge = sums.withColumn("before", run - F.col("n")).where(F.col("before") + F.col("n") > F.col("rest"))
    edge = edge.groupBy(*levels).agg(F.min(F.struct("at", "before")).alias("e")).select(*levels, F.col("e.at").alias("edge"), F.col("e.before").alias("before"))
    docs = docs.join(F.broadcast(edge), levels, "left")
    sure = docs.withColumn("more", ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("at") < F.col("edge")))).cast("int"))
    # documents of one stretch a leaf
    within = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("h", "id"))
    near = sure.where("rest > 0 and at = edge").withColumn("more", (F.col("before") + within - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    columns = ["id", "source", "n_tokens", (F.col("epochs") + F.col("more")).alias("n_used")]
    mixed = sure.where("not coalesce(rest > 0 and at = edge, false)").select(*columns).unionByName(near.select(*columns)).where("n_used > 0")
    mixed = materialize(mixed, "mixture")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_used")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n_used").alias("most_used"))
    had: dict = {}
    for r in leaves:
        had[r["source"]] = had.get(r["source"], 0) + r["tokens"]
    listed = spark.createDataFrame([(k, s, had.get(k, 0)) for k, s in shares.items()], "source string, target_share double, available long")
    whole = F.sum("tokens").over(Window.partitionBy())
    report = listed.join(used, "source", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "documents", "most_used")})
    report = report.withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole), F.lit(0.0)), 6))
    return mixed, report.select("source", "target_share", "actual_share", "tokens", "documents", "most_used", "available")
