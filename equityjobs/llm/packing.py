"""Packing token pieces into windows by minimum bin slack.

Documents are cut into full windows and one remaining piece. The remaining pieces are packed by length:
a bitset subset-sum program picks, for the longest piece left, the multiset of other lengths that comes
closest to the capacity; the pattern is used as often as the counts allow. Only the histogram of lengths
(less than ``capacity`` rows) is on the driver; pieces find their windows by rank within their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityjobs.llm.shared import salted_rank, stored
from equityjobs.llm.tokens import token_ids


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is largest within ``room``; longer pieces are used first.

    Bit s of ``reach[i]`` says that the i shortest lengths can add up to s.
    """
    lengths = sorted(n for n, c in counts.items() if 0 < n <= room and c > 0)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for n in lengths:
        bits, left, step = reach[-1], min(counts[n], room // n), 1
        while left > 0:
            step = min(step, left)
            bits |= (bits << (n * step)) & mask
            left -= step
            step *= 2
        reach.append(bits)
    total, used = reach[-1].bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        k = min(counts[n], total // n)
        while not (reach[i] >> (total - k * n)) & 1:
            k -= 1
        if k:
            used[n] = k
            total -= k * n
    return used


def minimum_slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a window, number of such windows), until no piece is left."""
    counts, patterns = dict(counts), []
    while counts:
        longest = max(counts)
        left = counts | {longest: counts[longest] - 1}
        used = fill(left, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        patterns.append((used, times))
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return patterns


def pack(pieces: DataFrame, capacity: int = 1024, length_col: str = "length", order: tuple[str, ...] = ("uid", "start")) -> DataFrame:
    """Add sequence_id and offset (both from 0, gapless) to ``pieces``, whose lengths are 1 to ``capacity``.

    ``order`` must tell pieces apart. Other columns are kept; an empty table stays empty. ``pieces`` is read
    several times and should be a stored table.
    """
    spark = pieces.sparkSession
    payload = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keys = [f"_key{i}" for i in range(len(order))]
    # All columns of a piece travel in one struct, so no name can clash.
    wrapped = pieces.select(F.struct(*payload).alias("_piece"), F.col(length_col).cast("long").alias("_length"), *[F.col(c).alias(k) for c, k in zip(order, keys)])
    whole, rest = wrapped.filter(F.col("_length") >= capacity), wrapped.filter(F.col("_length") < capacity)
    full = salted_rank(whole, [], keys, "sequence_id").withColumn("offset", F.lit(0).cast("long"))
    counts = {r["n"]: r["c"] for r in rest.groupBy(F.col("_length").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}  # below capacity rows
    window = whole.count()
    rows, taken = [], dict.fromkeys(counts, 0)
    for used, times in minimum_slack_patterns(counts, capacity):
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, taken[n], taken[n] + k * times, k, window, offset))
            taken[n] += k * times
            offset += n * k
        window += times
    # At most capacity * ln(capacity) patterns of at most sqrt(2 * capacity) lengths, whatever the input.
    plan = spark.createDataFrame(rows, "_n long, _lo long, _hi long, _k long, _window long, _offset long")
    ranked = salted_rank(rest, ["_length"], keys, "_rank")
    on = (F.col("_length") == F.col("_n")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    index = F.col("_rank") - F.col("_lo")
    placed = ranked.join(F.broadcast(plan), on).select(
        "_piece.*",
        (F.col("_window") + F.floor(index / F.col("_k"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (index % F.col("_k")) * F.col("_length")).cast("long").alias("offset"),
    )
    return full.select("_piece.*", "sequence_id", "offset").unionByName(placed)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, start, length, doc_tokens, ids: each document's ids (end id last) in windows of ``capacity`` and a rest.

    A null or empty text is the end id alone; repeated rows are documents of their own.
    """
    tokens = token_ids(docs, tokenizer, end_id, id_col, text_col)
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long"))
    cut = tokens.select("uid", "doc_id", F.col("n_tokens").alias("doc_tokens"), "ids", F.explode(starts).alias("start"))
    length = F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start"))
    part = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (length * 4).cast("int"))
    return cut.select("uid", "doc_id", "start", length.alias("length"), "doc_tokens", part.alias("ids"))


def packed_digest(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """The pieces of all documents with their windows and a checksum of their ids."""
    pieces = pieces_of(docs, tokenizer, end_id, capacity)
    slim = stored(pieces.select("uid", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return pack(slim, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
