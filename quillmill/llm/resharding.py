"""Resharding by minimum-cost flow.

Given the sizes of the old shards and the capacities of the new ones, a flow network decides how many bytes stay
and how many go where, so that the fewest bytes move; old shards that lose or gain something are written anew.

The network has a node for each old and each new shard and one hub: bytes stay at no cost, going to the hub costs
1 for each byte, leaving it nothing.  It has as many arcs as shards, so the driver can solve it for any number.

Documents are ordered by a 64-bit key (a digest of id and text); the first BLOCK_BITS bits are the block.  Bytes
that leave a shard are its first documents in that order, so that a transfer is a range of keys: whole blocks, and
parts of those at its ends.  A shard may pass its capacity by less than one document for each transfer.

Scale: the driver holds totals and transfers of shards; block sizes stay distributed.  Only documents that move are
shuffled; what stays of an affected shard is copied where it is read, other shards aren't touched.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import fresh, shared_dir

BLOCK_BITS = 8
#: Transfers, and shards, are broadcast up to so many, joined by shuffle beyond.
BROADCAST_TRANSFERS = 100_000
#: Bytes of text that come to one shard and are written by one task.
FILE_BYTES = 64_000_000


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow from s to t of least cost.

    Primal-dual: shortest distances, then a blocking flow over the arcs on shortest paths, until t is cut off.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        cost.append(w)
        out[b].append(len(to))
        to.append(a)
        cap.append(0)
        cost.append(-w)
    potential = [0] * n
    while True:
        far = [None] * n
        far[s] = 0
        heap = [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] and (far[to[e]] is None or d + cost[e] + potential[x] - potential[to[e]] < far[to[e]]):
                    far[to[e]] = d + cost[e] + potential[x] - potential[to[e]]
                    heapq.heappush(heap, (far[to[e]], to[e]))
        if far[t] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for x in range(n):
            potential[x] += far[t] if far[x] is None else min(far[x], far[t])
        while True:  # Dinic on arcs of reduced cost 0
            level = [-1] * n
            level[s], queue = 0, deque([s])
            while queue:
                x = queue.popleft()
                for e in out[x]:
                    if cap[e] and level[to[e]] < 0 and cost[e] + potential[x] - potential[to[e]] == 0:
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if level[t] < 0:
                break
            at = [0] * n
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    amount = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= amount
                        cap[e ^ 1] += amount
                    cut = next(i for i, e in enumerate(path) if not cap[e])
                    x = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while at[x] < len(out[x]):
                    e = out[x][at[x]]
                    if cap[e] and level[to[e]] == level[x] + 1 and cost[e] + potential[x] - potential[to[e]] == 0:
                        break
                    at[x] += 1
                if at[x] < len(out[x]):
                    path.append(e)
                    x = to[e]
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def transfers(sizes: dict[str, int], capacities: dict[str, int]) -> list[tuple[str, str, int, int]]:
    """(old shard, new shard, from byte, to byte): what leaves each old shard, by its first bytes, so that the fewest move."""
    old, new = sorted(sizes), sorted(capacities)
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the new shards hold less than the old ones have")
    s, t, hub = 0, 1, 2
    old_at = {x: 3 + i for i, x in enumerate(old)}
    new_at = {x: 3 + len(old) + i for i, x in enumerate(new)}
    total = sum(sizes.values())
    arcs = [(s, old_at[x], sizes[x], 0) for x in old] + [(old_at[x], hub, sizes[x], 1) for x in old]
    arcs += [(hub, new_at[x], total, 0) for x in new] + [(new_at[x], t, capacities[x], 0) for x in new]
    arcs += [(old_at[x], new_at[x], sizes[x], 0) for x in old if x in new_at]
    flow = min_cost_flow(3 + len(old) + len(new), arcs, s, t)
    leaving = [[x, f] for x, f in zip(old, flow[len(old) : 2 * len(old)], strict=True) if f]
    coming = [[x, f] for x, f in zip(new, flow[2 * len(old) : 2 * len(old) + len(new)], strict=True) if f]
    out, done = [], 0
    while leaving:
        amount = min(leaving[0][1], coming[0][1])
        out.append((leaving[0][0], coming[0][0], done, done + amount))
        done += amount
        leaving[0][1] -= amount
        coming[0][1] -= amount
        if not leaving[0][1]:
            leaving.pop(0)
            done = 0
        if not coming[0][1]:
            coming.pop(0)
    return out


def grown(sizes: dict[str, int], growth: float = 1.25, slack: float = 1.02) -> dict[str, int]:
    """Capacities for growth times as many shards, the old ones among them, all alike and slack times as large as needed."""
    n = max(len(sizes) + 1, round(len(sizes) * growth)) if sizes else 0
    names = sorted(sizes) + [f"added-{i:05d}" for i in range(n - len(sizes))]
    return dict.fromkeys(names, int(sum(sizes.values()) * slack / max(1, n)) + 1)


def _key_ranges(rows: DataFrame, moves: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int | None, int | None]]:
    """The transfers as ranges of keys (from inclusive, to exclusive, None without end); rows: shard, key, block, bytes."""
    spark = rows.sparkSession
    ends = sorted({(a, hi) for a, _, _, hi in moves})
    marks = spark.createDataFrame(ends, "mark_shard string, mark bigint")
    blocks = rows.groupBy("shard", "block").agg(F.sum("bytes").alias("bytes"))
    base = F.sum("bytes").over(Window.partitionBy("shard").orderBy("block")) - F.col("bytes")
    blocks = blocks.select("shard", "block", base.alias("base"), (base + F.col("bytes")).alias("top"))
    ending = blocks.join(marks, (F.col("shard") == F.col("mark_shard")) & (F.col("base") < F.col("mark")) & (F.col("mark") <= F.col("top")))
    ending = ending.select("mark_shard", F.col("block").alias("mark_block"), "base", "mark")
    inside = rows.join(ending.select("mark_shard", "mark_block").distinct(), (F.col("shard") == F.col("mark_shard")) & (F.col("block") == F.col("mark_block")), "left_semi")
    upto = F.sum("bytes").over(Window.partitionBy("shard", "block").orderBy("key"))  # rows of one key count together
    inside = inside.select("shard", "block", "key", upto.alias("upto"))
    last = (
        inside.join(ending, (F.col("shard") == F.col("mark_shard")) & (F.col("block") == F.col("mark_block")) & (F.col("base") + F.col("upto") >= F.col("mark")))
        .groupBy("mark_shard", "mark").agg(F.min("key").alias("last")).collect()
    )
    at = {(r["mark_shard"], r["mark"]): r["last"] for r in last}
    return [(a, b, at.get((a, lo)) if lo else None, at[a, hi]) for a, b, lo, hi in moves]


def reshard(docs: DataFrame, shard: Column, capacities: dict[str, int] | Callable[[dict[str, int]], dict[str, int]], out_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, old_shard, new_shard, n_bytes: the new layout of docs, one row for each row.

    shard names the shard in which a row is; capacities are bytes of text by new shard (or a function that makes them
    of the old shards' sizes), of which those that have an old shard's name are that shard.  The rows of shards that lose or gain something are written below out_path, in
    a folder for each new shard, with all their columns; rows of the others stay in the files they are in.

    A null shard is the shard ''; null and empty texts have no bytes and stay, unless nothing of their shard does.
    Very long texts move whole.  Rows alike in id and text stay together.  An empty table gives an empty one.  Too little capacity is an error.
    """
    spark = docs.sparkSession
    out_path = out_path or shared_dir(spark) + "/shards"
    old, key, to = fresh(docs.columns, "old_shard", "shard_key", "shard")
    marked = docs.withColumns({old: F.coalesce(shard.cast("string"), F.lit("")), key: F.xxhash64(docs[doc_id], docs[text])})
    block = F.shiftright(F.col(key), 64 - BLOCK_BITS)  # signed, as keys are compared
    rows = marked.select(F.col(old).alias("shard"), F.col(key).alias("key"), block.alias("block"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    capacities = capacities(sizes) if callable(capacities) else capacities
    moves = transfers(sizes, capacities)
    ranges = _key_ranges(rows.where("bytes > 0"), moves) if moves else []
    home = {a: b for a, b, _, _ in moves}  # all that is left of a shard that goes goes with its last transfer
    homes = {x: x if x in capacities else home.get(x) or min(capacities) for x in sizes}
    touched = {x for a, b, _, _ in moves for x in (a, b)} | {x for x in sizes if x not in capacities}
    coming: dict[str, int] = {}
    for _, b, lo, hi in moves:
        coming[b] = coming.get(b, 0) + hi - lo
    s_old, s_home, s_touched, p_from, p_to, low, high, first, files = fresh(marked.columns, "plan_shard", "home", "touched", "plan_from", "plan_to", "low", "high", "first", "files")
    shards = spark.createDataFrame([(x, homes[x], x in touched) for x in sizes], f"`{s_old}` string, `{s_home}` string, `{s_touched}` boolean")
    shards = F.broadcast(shards) if len(sizes) <= BROADCAST_TRANSFERS else shards
    plan = spark.createDataFrame(
        [(a, b, lo if lo is not None else -(1 << 63), hi, lo is None, -(-coming[b] // FILE_BYTES)) for a, b, lo, hi in ranges],
        f"`{p_from}` string, `{p_to}` string, `{low}` bigint, `{high}` bigint, `{first}` boolean, `{files}` bigint",
    )
    plan = F.broadcast(plan) if len(ranges) <= BROADCAST_TRANSFERS else plan
    inside = (F.col(old) == F.col(p_from)) & (F.col(key) <= F.col(high)) & (F.col(first) | (F.col(key) > F.col(low))) & (F.octet_length(F.col(text)) > 0)
    known = marked.join(shards, F.col(old) == F.col(s_old))
    changed = known.where(F.col(s_touched)).join(plan, inside, "left").withColumn(to, F.coalesce(F.col(p_to), F.col(s_home))).drop(s_old, s_home, s_touched, p_from, p_to, low, high, first)
    moved = F.col(to) != F.col(old)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    changed.where(~moved).drop(key, files).write.mode("append").partitionBy(to).parquet(out_path)
    # a shard that many bytes come to is written by several tasks
    changed.where(moved).repartition(n, F.col(to), F.pmod(F.col(key), F.coalesce(F.col(files), F.lit(1)))).drop(key, files).write.mode("append").partitionBy(to).parquet(out_path)

    def layout(df: DataFrame) -> DataFrame:
        return df.select(F.col(doc_id).alias("doc_id"), F.col(old).alias("old_shard"), F.col(to).alias("new_shard"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))

    written = spark.read.schema(changed.drop(key, files).schema).parquet(out_path)
    kept = known.where(~F.col(s_touched))
    return layout(written).union(layout(kept.withColumn(to, F.col(old))))
