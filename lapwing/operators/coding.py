"""Entropy coding as aggregation: tallies, optimal length-limited prefix codes, codewords, costs and checks."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import lit


#: Books that are designed together at most.
MOST_BOOKS = 4096


def tally(emissions: DataFrame, book: Column, symbol: Column) -> DataFrame:
    """(book, symbol, n)."""
    return emissions.groupBy(book.alias("book"), symbol.alias("symbol")).agg(F.count("*").alias("n"))


def entropy(tallies: DataFrame) -> DataFrame:
    """(book, total, symbols, bits): ideal bits, no symbol below 1/1000 of a bit."""
    total = tallies.groupBy("book").agg(F.sum("n").alias("total"), F.count("*").alias("symbols"))
    each = tallies.join(total, "book").withColumn("b", F.col("n") * F.greatest(-F.log2(F.col("n") / F.col("total")), lit(0.001)))
    return each.groupBy("book", "total", "symbols").agg(F.sum("b").alias("bits"))


def _lengths(counts: list[int], most: int) -> list[int]:
    """Optimal code lengths of at most `most` bits for positive counts, by package-merge; of equal counts, earlier symbols get the shorter."""
    if len(counts) == 1:
        return [1]
    order = sorted(range(len(counts)), key=lambda k: (counts[k], -k))
    coins = [(counts[k], (k,)) for k in order]
    row = coins
    for _ in range(most - 1):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(coins + packages, key=lambda c: c[0])
    out = [0] * len(counts)
    for _, held in row[: 2 * len(counts) - 2]:
        for k in held:
            out[k] += 1
    return out


def _free_lengths(counts: list[int]) -> list[int]:
    """Optimal code lengths of any size for positive counts, by merging the two smallest weights again and again."""
    if len(counts) == 1:
        return [1]
    heap = [(n, k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    above = [0] * (2 * len(counts) - 1)  # each node's parent; nodes are numbered as they are made
    for made in range(len(counts), len(above)):
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = made
        heapq.heappush(heap, (n + m, made))
    depth = [0] * len(above)
    for k in range(len(above) - 2, -1, -1):
        depth[k] = depth[above[k]] + 1
    return depth[: len(counts)]


def code_lengths(tallies: DataFrame, most: int | None = 24) -> DataFrame:
    """(book, symbol, n, length) of an optimal prefix code for each book, of at most `most` bits a symbol, or of any number of bits
    if that is None. A book is its alphabet, already counted, so groups are small."""

    def design(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("symbol", ignore_index=True)
        if most is None:
            return book.assign(length=_free_lengths(book.n.tolist()))
        if len(book) > 1 << most:
            raise ValueError(f"{len(book)} symbols have no code of {most} bits")
        return book.assign(length=_lengths(book.n.tolist(), most))

    return tallies.groupBy("book").applyInPandas(design, "book string, symbol string, n long, length int")


def dense(tallies: DataFrame, alphabet: DataFrame) -> DataFrame:
    """tallies (book, symbol, n) with a count of 1 for every symbol of the alphabet that a book lacks: books times symbols, as a full design has.

    A design has at most MOST_BOOKS books, whose names are known to the driver; more are an error.
    """
    books = [r.book for r in tallies.select("book").distinct().limit(MOST_BOOKS + 1).collect()]
    if len(books) > MOST_BOOKS:
        raise ValueError(f"more than {MOST_BOOKS} books to design at once")
    names = F.array(*map(F.lit, sorted(books, key=lambda b: (b is not None, b)))).cast(f"array<{dict(tallies.dtypes)['book']}>")
    every = alphabet.select("symbol", F.explode(names).alias("book")) if books else tallies.select("symbol", "book").limit(0)
    seen = tallies.select(F.col("book").alias("_book"), F.col("symbol").alias("_symbol"), "n")
    met = every.join(seen, F.col("book").eqNullSafe(F.col("_book")) & (F.col("symbol") == F.col("_symbol")), "left")
    return met.select("book", "symbol", F.coalesce("n", F.lit(1).cast("long")).alias("n"))


def codewords(lengths: DataFrame) -> DataFrame:
    """(book, symbol, length, code): in order of symbol, each takes the lowest free codeword of its length."""

    def assign(book: pd.DataFrame) -> pd.DataFrame:
        book, free, codes = book.sort_values("symbol", ignore_index=True), [""], []
        for n in book.length:
            fits = [f for f in free if len(f) <= n]
            if not fits:
                raise ValueError("more codewords than the lengths leave room for")
            at = min(fits)
            free.remove(at)
            code = at + "0" * (n - len(at))
            free += [code[:k] + "1" for k in range(len(at), n)]
            codes.append(code)
        return book.assign(code=codes)[["book", "symbol", "length", "code"]]

    return lengths.select("book", "symbol", "length").groupBy("book").applyInPandas(assign, "book string, symbol string, length int, code string")


def kraft(lengths: DataFrame) -> DataFrame:
    """(book, symbols, kraft, complete): the sum of 2^-length, and whether the tree is exactly full."""
    of = lengths.groupBy("book").agg(F.count("*").alias("symbols"), F.sum(F.pow(lit(2), -F.col("length"))).alias("kraft"))
    return of.withColumn("complete", (F.col("kraft") == 1) | (F.col("symbols") == 1))


def stream_cost(tallies: DataFrame, lengths: DataFrame) -> DataFrame:
    """(book, bits): what the counted symbols cost; null for a book with a symbol that has no code."""
    joined = tallies.join(lengths.select("book", "symbol", "length"), ["book", "symbol"], "left")
    return joined.groupBy("book").agg(F.when(F.count_if(F.col("length").isNull()) == 0, F.sum(F.col("n") * F.col("length"))).alias("bits"))
