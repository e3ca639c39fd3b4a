"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.ranking import positions
from runledger.session import stage

BITS = 8
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def stored_bytes(text: Column) -> Column:
    """UTF-8 bytes plus a fixed share for the other columns."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def name_code(value: Column, bits: int = BITS) -> Column:
    """A name's cell, spread evenly; null has the first one."""
    code = F.pmod(F.crc32(value.cast("string")), F.lit(1 << bits))
    return F.coalesce(code, F.lit(0)).cast("int")


def magnitude_code(value: Column, bits: int = BITS) -> Column:
    """A size's cell on a logarithmic scale, the same for every table; null has the first."""
    steps = (1 << bits) // 32
    cell = F.floor(F.log2(F.greatest(value, F.lit(1))) * steps)
    return F.coalesce(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve through ``len(cells)`` dimensions of ``bits``.

    Turns coordinates into the curve's transposed index one bit plane after another
    (Skilling 2004), all in built-in functions on an array of whole numbers.
    """
    n = len(cells)
    planes = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(
        *[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in planes for i in range(n)]
    )

    def turn(x: Column, s: Column) -> Column:
        first, own, low = x[0], F.element_at(x, s["i"] + 1), s["q"] - 1
        hit = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, first.bitwiseXOR(F.when(hit, low).otherwise(swap)))
            .when((k == s["i"]) & ~hit, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    def gray(x: Column) -> Column:
        codes = [x[0]]
        for i in range(1, n):
            codes.append(x[i].bitwiseXOR(codes[-1]))
        return F.array(*codes)

    def flip(x: Column) -> Column:
        last = x[n - 1]
        mask = F.aggregate(
            F.array(*[F.lit(q) for q in planes]),
            F.lit(0),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        return _let(mask, lambda m: F.transform(x, lambda v: v.bitwiseXOR(m)))

    def interleave(x: Column) -> Column:
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(x[i], b).bitwiseAND(F.lit(1)).cast("long")
                index = F.shiftleft(index, 1).bitwiseOR(bit)
        return index

    start = F.array(*[c.cast("int") for c in cells])
    turned = F.aggregate(steps, start, turn)
    return _let(_let(_let(turned, gray), flip), interleave)


def _placed(docs: DataFrame, n_shards: int, carried: Sequence[str]) -> DataFrame:
    """Rows with the columns named in ``carried`` and those of ``ADDED`` and the cell."""
    size = stored_bytes(F.col("text"))
    cells = {
        "lang_cell": name_code(F.col("lang")),
        "source_cell": name_code(F.col("source")),
        "size_cell": magnitude_code(size),
    }
    digest = {"size": size, "text_crc32": F.crc32(F.col("text")), "__text": F.xxhash64("text")}
    own = docs.select(*[F.col(c).alias(f"__own_{c}") for c in carried], "doc_id", *[
        c.alias(name) for name, c in (cells | digest).items()
    ])
    own = own.withColumn("curve", hilbert_index([F.col(c) for c in cells]))
    # Only texts whose rows lie apart: these go where the first of them on the curve goes.
    same = own.where("text_crc32 IS NOT NULL").groupBy("size", "__text")
    same = same.agg(F.min("curve").alias("__curve"), F.max("curve").alias("__last"))
    same = stage(same.where("__curve < __last").drop("__last"), "copies")
    rows = own.join(same, ["size", "__text"], "left")
    rows = rows.withColumn("curve", F.coalesce("__curve", "curve")).drop("__curve")
    placed, total = positions(rows, ["curve", "size", "text_crc32", "__text", "doc_id"], "__place")
    n = max(total, 1)
    shard = F.expr(f"(__place * {n_shards}L) div {n}L")
    first = F.expr(f"(__shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("__shard", shard).withColumn("__first", first)
    return placed.select(
        *[F.col(f"__own_{c}").alias(c) for c in carried],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__place") - F.col("__first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *cells,
        "curve",
    )


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there; law ``rows``.

    Reads ``doc_id, text, lang, source``. Language, source and size are quantised, rows
    sorted by the cell's place on the Hilbert curve, then size and digest of the text and
    id, and the order is cut into runs whose lengths differ by one at most. Files of a run
    span few languages, sources and sizes, which is what a reader prunes by. Rows with
    equal texts all take the first place any of them has on the curve, so they lie
    together whatever their other columns say, and only a cut can part them. Rows are
    numbered in ranges; nothing is gathered.

    Returns ``doc_id``, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (from 0), ``grown_shard`` (null, as a new shard moves runs), the
    cell and the place on the ``curve``. A null text has size 16 and no digest; a null name lies in the first cell;
    rows equal in all of this may swap slots. Other columns of ``docs`` are not read.
    """
    return _placed(docs, n_shards, ["doc_id"])


def shard_corpus(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """``docs`` whole, with the columns ``shard_documents`` adds.

    Rows carry their own columns through the sort, so rows that share an id, or have
    none, each keep theirs. Input columns of the added names are replaced.
    """
    added = (*ADDED, "lang_cell", "source_cell", "size_cell", "curve")
    return _placed(docs, n_shards, [c for c in docs.columns if c not in added])


def write_shards(corpus: DataFrame, path: str) -> None:
    """What ``shard_corpus`` gives as Parquet, one folder per shard, rows in slot order."""
    ordered = corpus.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
