"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts form a group. Groups with a notable share of any dimension are items of their own, the
largest cut into parts; all others fall into a fixed number of hashed lots. So the number of items
is bounded at any size of the corpus, and the driver places them, largest first, each where the dot
product of its vector with the residual capacity is highest among the shards that can take it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import rank_within, written

SHARDS, LOTS = 24, 8192


#: What deviations in bytes, tokens and rows weigh when shards are levelled: the law is on bytes.
WEIGHTS = np.array([16.0, 4.0, 4.0])


def place(items: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each row (bytes, tokens, rows): the highest dot product with the residual capacity, among shards with room in all three."""
    total = items.sum(0)
    need = items / np.where(total > 0, total / shards, 1)
    left, out = np.ones((shards, need.shape[1])), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -need.max(1))):
        v = need[i]
        fits = (left >= v).all(1)
        s = int(np.where(fits, left @ v, -np.inf).argmax()) if fits.any() else int((left - v).min(1).argmax())
        left[s] -= v
        out[i] = s
    return _level(need, out, shards)


def _level(need: np.ndarray, out: np.ndarray, shards: int, rounds: int = 1500, most: int = 192) -> np.ndarray:
    """Evens all three dimensions: moves an item, or swaps two, between the shard that deviates most and one that deviates the other way, while that helps.

    At most `most` items of a shard, spread over their sizes, are looked at in a round.
    """
    load = np.zeros((shards, need.shape[1]))
    np.add.at(load, out, need)
    off = load - load.mean(0)
    settled = np.zeros(shards, bool)
    for _ in range(rounds):
        cost = (off * off @ WEIGHTS[: off.shape[1]]) * ~settled
        a = int(cost.argmax())
        if cost[a] < 1e-9:
            break
        done = False
        for b in np.argsort(off * WEIGHTS[: off.shape[1]] @ off[a], kind="stable")[:3].tolist():
            x, y = (_spread(np.flatnonzero(out == s), need, most) for s in (a, b))
            # Row 0 and column 0 stand for no item: moves in either direction are swaps with nothing.
            vx, vy = (np.concatenate([np.zeros((1, need.shape[1])), need[i]]) for i in (x, y))
            v = vx[:, None, :] - vy[None, :, :]
            gain = ((v * v - v * (off[a] - off[b])) * WEIGHTS[: off.shape[1]]).sum(2)
            i, j = np.unravel_index(int(gain.argmin()), gain.shape)
            if gain[i, j] < -1e-12:
                off[a] -= v[i, j]
                off[b] += v[i, j]
                if i:
                    out[x[i - 1]] = b
                if j:
                    out[y[j - 1]] = a
                done, settled[b] = True, False
                break
        settled[a] = not done
    return out


def _spread(items: np.ndarray, need: np.ndarray, most: int) -> np.ndarray:
    items = items[np.argsort(need[items, 0], kind="stable")]
    return items if len(items) <= most else items[np.linspace(0, len(items) - 1, most).astype(int)]


def assign(docs: DataFrame, shards: int = SHARDS, lots: int = LOTS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot; under the law `bytes`.

    Null text has no bytes and equals empty text. Rows repeat as given; an empty table gives no rows;
    further columns of `docs` are ignored. A group holding more than an eighth of a shard is cut by
    doc_id, so that one text may fill several shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    words = (F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            words.alias("tokens"),
            F.unhex(F.md5(text)).alias("key"),
        )
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")]
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()[0]
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    grouped = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    lot = F.pmod(F.xxhash64("key"), F.lit(lots)).cast("int")
    share = F.greatest(*(F.col(c) / float(max(1, total[c])) for c in ("size", "tokens", "rows")))
    # At most 3 x lots groups can have such a share.
    heavy = grouped.where((share >= 1.0 / lots) & (F.col("rows") > 1)).withColumn("share", share).collect()
    light = grouped.where(~((share >= 1.0 / lots) & (F.col("rows") > 1))).groupBy(lot.alias("lot")).agg(*sums).collect()
    parts = {bytes(r["key"]): max(1, min(r["rows"], int(np.ceil(r["share"] * shards * 8)))) for r in heavy}
    out = rows.withColumn("lot", lot).withColumn("part", F.lit(None).cast("int"))
    cut = []
    if parts:
        cuts = spark.createDataFrame([(bytearray(k), n) for k, n in parts.items()], "hk binary, hn int")  # bounded as `heavy`
        part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("hn")).cast("int")
        out = out.drop("part").join(F.broadcast(cuts), F.col("key") == F.col("hk"), "left").withColumn("part", part)
        # Parts are counted, not assumed equal.
        cut = out.where("hk is not null").groupBy("hk", "part").agg(
            F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
        ).collect()
    vectors = [[r["size"], r["tokens"], r["rows"]] for r in [*cut, *light]]
    got = place(np.array(vectors, float).reshape(-1, 3), shards).tolist()
    of_lot = [-1] * lots
    for r, s in zip(light, got[len(cut) :], strict=True):
        of_lot[r["lot"]] = s
    lot_shard = F.element_at(F.expr(f"split('{','.join(map(str, of_lot))}', ',')"), F.col("lot") + 1).cast("int")
    if cut:
        shards_of = {k: [-1] * n for k, n in parts.items()}
        for r, s in zip(cut, got, strict=False):
            shards_of[bytes(r["hk"])][r["part"]] = s
        places = spark.createDataFrame([(bytearray(k), v) for k, v in shards_of.items()], "pk binary, ps array<int>")
        out = out.join(F.broadcast(places), F.col("hk") == F.col("pk"), "left").withColumn(
            "shard", F.when(F.col("pk").isNotNull(), F.get("ps", F.col("part"))).otherwise(lot_shard)
        )
    else:
        out = out.withColumn("shard", lot_shard)
    placed = written(out.select("doc_id", "size", "text_crc32", "shard"))
    return rank_within(placed, "shard", ["doc_id", "text_crc32", "size"]).withColumnRenamed("rank", "slot")
