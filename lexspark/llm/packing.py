"""Filling fixed-capacity containers with items (problem 8).

Texts are measured in tokens of a public tokenizer where they lie. A text longer than a container's capacity is cut
into full pieces, one container each, and a rest; everything else stays whole. Items are then packed by vector
best-fit in decreasing order: a container has residual tokens, residual document places and residual attention cost
(the sum of squared lengths), and among the open containers in which an item fits under every constraint the one
is taken whose residual vector, weighted and relative to its capacity, has the smallest norm after placement.
Without a fitting container a new one is opened, so nothing is dropped. A container's first item is always let in: a
text within the token capacity may cost more than shared containers are allowed, but must not be split.

Each kind has its own limits: columns capacity_documents and capacity_cost of the containers where they exist and are
not null, else what PLACE and COST give. Every one of the three excludes containers on its own.

Items are packed in shards of bounded size by a hash of their id, so no task grows with the data; each shard leaves
at most a few containers partly filled. Texts that are null or without tokens need no room: they come out without a
container. A document delivered twice is packed once.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import written

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level tokenizer divides text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a shard.
SHARD_ITEMS = 20_000
#: Document places and attention cost of a container, by its tokens: places = tokens / PLACE, cost = tokens ** 2 * COST.
#: Texts shorter than PLACE tokens on average use up the places first, a long text beside others the cost.
PLACE, COST = 16, 0.95
#: Weights of the residuals of tokens, places and cost.
WEIGHTS = (1.0, 0.05, 0.1)


def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); a null text has 0."""
    path = os.path.join(folder, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id bigint, n_tokens bigint")


def best_fit(sizes: list[int], tokens: int, places: int, cost: float) -> list[tuple[int, int]]:
    """(container, offset) of each item, in the given order; sizes are at most `tokens`, places at least 1."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    left: list[list[float]] = []  # residual tokens, places, cost
    # containers by residual tokens, then residual places; each list in order of residual cost
    classes: dict[int, dict[int, list[tuple[float, int]]]] = {}
    keys: list[int] = []  # the residuals there are, in order
    for i in order:
        s = sizes[i]
        best, norm = -1, math.inf
        for k in range(bisect.bisect_left(keys, s), len(keys)):
            r = keys[k]
            # squares of what is used sum up to the used tokens' square at most: no container of this class or of one
            # with more room has a smaller norm
            free = max(0.0, cost - (tokens - r) ** 2 - s * s) / cost
            if WEIGHTS[0] * ((r - s) / tokens) ** 2 + WEIGHTS[2] * free**2 > norm:
                break
            for p, row in classes[r].items():
                # of equal tokens and places, the least cost that fits
                if (j := bisect.bisect_left(row, (s * s, -1))) < len(row):
                    n = sum(w * x * x for w, x in zip(WEIGHTS, ((r - s) / tokens, (p - 1) / places, (row[j][0] - s * s) / cost)))
                    if n < norm:
                        best, norm = row[j][1], n
        if best < 0:
            best = len(left)
            left.append([tokens, places, cost])
        else:
            old, p, c = left[best]
            row = classes[old][p]
            row.pop(bisect.bisect_left(row, (c, best)))
            if not row:
                del classes[old][p]
            if not classes[old]:
                del classes[old]
                keys.pop(bisect.bisect_left(keys, old))
        out[i] = (best, tokens - int(left[best][0]))
        left[best][0] -= s
        left[best][1] -= 1
        left[best][2] -= s * s
        now, p, c = left[best]
        if now > 0 and p >= 1:
            if now not in classes:
                classes[now] = {}
                bisect.insort(keys, now)
            bisect.insort(classes[now].setdefault(p, []), (c, best))
    return out


def limits(containers: DataFrame) -> list[tuple[str, int, int, float]]:
    """(container_kind, tokens, places, cost) of the handful of kinds with a positive capacity; of repeated kinds the largest."""
    given = [F.max(c).alias(c) if c in containers.columns else F.lit(None).alias(c) for c in ("capacity_documents", "capacity_cost")]
    kinds = containers.filter("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("tokens"), *given)
    return [(r[0], int(r[1]), max(1, int(r[1]) // PLACE if r[2] is None else int(r[2])), float(COST * int(r[1]) ** 2 if r[3] is None else r[3])) for r in kinds.collect()]


def packed(documents: DataFrame, containers: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, doc_id, piece, n_tokens, container_id, position, offset): each text or piece in its place.

    position numbers the items of a container, offset is the first token's place in it. Kinds without a positive
    capacity hold nothing. container_id is unique within a kind.
    """
    # every text is tokenized once, and its size read by each part of the result
    sizes = written(measured(documents, folder, vocabulary).dropDuplicates(["doc_id", "n_tokens"]))
    offered = limits(containers)
    capacity_of = {k: (places, cost) for k, _, places, cost in offered}
    # every item goes into each kind
    options = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c, _, _ in offered]) if offered else F.expr("cast(array() as array<struct<container_kind:string,capacity:bigint>>)")
    x = sizes.select("doc_id", "n_tokens", F.explode(options).alias("o")).select("doc_id", F.col("n_tokens").alias("total"), "o.container_kind", "o.capacity")
    empty = x.filter("total = 0").select("container_kind", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("bigint").alias("offset"))
    x = x.filter("total > 0").withColumn("piece", F.explode(F.expr("sequence(0, cast((total - 1) div capacity as int))")))
    x = x.withColumn("n_tokens", F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")))
    full = x.filter("n_tokens = capacity").select(
        "container_kind", "doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("f"), F.coalesce("doc_id", F.lit(-1)), "piece").alias("container_id"), F.lit(0).alias("position"), F.lit(0).cast("bigint").alias("offset")
    )
    shards = max(1, math.ceil(sizes.count() / SHARD_ITEMS))
    rest = x.filter("n_tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id", "total"), F.lit(shards)).cast("int"))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "piece", "n_tokens"], ignore_index=True)
        capacity = int(b["capacity"].iloc[0])
        at = best_fit(b["n_tokens"].tolist(), capacity, *capacity_of[b["container_kind"].iloc[0]])
        b["container_id"] = [f"s{b['shard'].iloc[0]}-{c}" for c, _ in at]
        b["offset"] = [o for _, o in at]
        b["position"] = b.groupby("container_id")["offset"].rank(method="first").astype(int) - 1
        return b[["container_kind", "doc_id", "piece", "n_tokens", "container_id", "position", "offset"]]

    schema = "container_kind string, doc_id bigint, piece int, n_tokens bigint, container_id string, position int, offset bigint"
    return rest.groupBy("container_kind", "shard").applyInPandas(pack, schema).unionByName(full).unionByName(empty)


def fill(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: items, containers and the share of their room that is unused."""
    per = placed.filter("container_id is not null").groupBy("container_kind", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    x = per.join(F.broadcast(containers), "container_kind").groupBy("container_kind", "capacity_tokens")
    return x.agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(1 - F.sum("tokens") / (F.count("*") * F.first("capacity_tokens")), 6).alias("unused"))
