"""Byte-level byte-pair encoding and decoding by higher-order functions over literal tables.

A rank file gives each token, a string of bytes, its rank, which is its id. A word, a match of the pattern, starts as the array of its bytes; a
fold over rounds looks up the rank of each pair of neighbours in the literal rank map and merges the pair of the least rank wherever it
stands, from the left, until no pair has a rank. That is the merging of one leftmost pair after another, as long as every token of the file comes out of
its own bytes by merges of lower ranks, which files of byte-pair encodings do and merges() checks: until a token is merged in a word, what
lies between its ends has gone the same way as in the token alone, so that one pair makes it, always the same.

The array is a string with a character for each piece, a byte's own or one that stands for a token: merging a pair everywhere is then a replacement of two
characters by one, and a pair is a key of two characters.

Words repeat, so the frequent ones are folded once and for all: counts over all documents tell which, up to a fixed number, and their ids are a
second literal map. Rarer words are folded where they stand. No document is ever shuffled: what moves is counts of distinct words.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_names
from lodestone.operators.lineage import forget, materialise

#: Words whose ids are kept: a bound for the second literal table, whatever the corpus.
FREQUENT = 350_000
#: Longer words aren't kept, which bounds the table in bytes too.
LONGEST = 48
#: Entries that share a bucket of a literal map, and of a literal text, on average.
SHARING, SHARING_TEXT = 2, 2
#: Behind the pieces of a word in which no pair is left to merge; stands for no token.
DONE = "\U0010fffd"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def character(rank: int) -> str:
    """What stands for a token of several bytes: characters that are no byte's and no surrogate."""
    code = 256 + rank
    return chr(code if code < 0xD800 else code + 0x800)


def merges(ranks: dict[bytes, int]) -> dict[str, int]:
    """The two characters of the last merge that makes each token of several bytes, and the token's rank."""
    name = {token: token.decode("latin-1") if len(token) == 1 else character(rank) for token, rank in ranks.items()}
    pairs = {}
    for token, own in ranks.items():
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            found = [ranks.get(a + b, own) for a, b in zip(pieces, pieces[1:])]
            least = min(found)
            if least >= own:
                raise ValueError(f"{token!r} isn't made by merges of lower ranks")
            i = found.index(least)
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        if len(pieces) == 2:
            pairs[name[pieces[0]] + name[pieces[1]]] = own
    return pairs


# ---- literal tables ----------------------------------------------------------------------------


def _mask(size: int, sharing: int) -> int:
    return (1 << max(0, (size // sharing).bit_length() - 1)) - 1


def _in_buckets(entries: DataFrame, mask: int, empty: str, together) -> list[str]:
    """What `together` makes of the entries of each bucket: that of the key's hash, so that looking up takes the same time however many
    entries there are. The driver holds them all as text; their number has to be bounded."""
    found = entries.groupBy(F.hash(entries.columns[0]).bitwiseAND(mask).alias("at")).agg(together.alias("text")).toArrow()
    out = [empty] * (mask + 1)
    for at, text in zip(found.column("at").to_pylist(), found.column("text").to_pylist()):
        out[at] = text
    return out


class LiteralMap:
    """A constant map of text to text as an expression: an array of small maps, which the optimizer folds into one literal. Fast to look up, slow to
    send: some objects an entry. entries: (key, value)."""

    def __init__(self, entries: DataFrame):
        self.mask = _mask(entries.count(), SHARING)
        maps = _in_buckets(entries, self.mask, "{}", F.to_json(F.map_from_entries(F.collect_list(F.struct(*entries.columns)))))
        self.literal = F.from_json(F.lit("[" + ",".join(maps) + "]"), "array<map<string, string>>")

    def get(self, table: Column, key: Column) -> Column:
        """The key's value, or null. table: the literal, or a variable that is bound to it."""
        return F.try_element_at(F.get(table, F.hash(key).bitwiseAND(self.mask)), key)


class LiteralText:
    """As LiteralMap, an array of texts that hold their keys and values between marks: slower to look up, fast to send, an object a bucket. Entries
    with a mark in them are left out; values aren't empty."""

    BEFORE, BETWEEN, APART = "\1", "\2", "\3"

    def __init__(self, entries: DataFrame):
        key, value = entries.columns
        entries = entries.where(~F.concat(key, value).rlike("[\1-\3]"))
        self.size = entries.count()
        self.mask = _mask(self.size, SHARING_TEXT)
        one = F.concat(F.lit(self.BEFORE), key, F.lit(self.BETWEEN), value)
        self.literal = F.split(F.lit(self.APART.join(_in_buckets(entries, self.mask, "", F.array_join(F.collect_list(one), "")))), self.APART)

    def get(self, table: Column, key: Column) -> Column:
        """The key's value, or ''."""
        behind = F.call_function("substring_index", F.get(table, F.hash(key).bitwiseAND(self.mask)), F.concat(F.lit(self.BEFORE), key, F.lit(self.BETWEEN)), F.lit(-1))
        return F.substring_index(behind, self.BEFORE, 1)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: the finish of a fold over nothing, which unlike a transform copies no result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, body)


# ---- documents ---------------------------------------------------------------------------------


class ByteBpe:
    """Encoding and decoding by the ranks of a file and a pattern that cuts text into words.

    ranks: tokens and ids, from read_ranks(); each byte has to be one. The pattern's white space is Unicode's.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        self.pattern = "(?U)" + pattern
        pairs = [(pair, character(rank)) for pair, rank in merges(ranks).items()]
        self.pairs = LiteralMap(SparkSession.active().createDataFrame(pairs, "pair string, merged string"))
        tokens = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token.hex()
        self.tokens = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
        self.of_bytes = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<int>")

    def fold(self, word: Column, pairs: Column) -> Column:
        """A word's pieces, a character each. pairs: the literal of self.pairs. Characters of tokens are in the order of their ranks."""

        def merged(pieces: Column, _: Column) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.char_length(pieces) - 1), lambda i: self.pairs.get(pairs, F.substring(pieces, i, 2)))
            pair = lambda found, least: F.substring(pieces, F.array_position(found, least).cast("int"), F.lit(2))
            done = F.concat(pieces, F.lit(DONE))
            merge = lambda found: let(F.array_min(found), lambda least: F.when(least.isNull(), done).otherwise(F.replace(pieces, pair(found, least), least)))
            return F.when(F.endswith(pieces, F.lit(DONE)), pieces).when(F.char_length(pieces) < 2, done).otherwise(let(found, merge))

        last = lambda pieces: F.replace(pieces, F.lit(DONE), F.lit(""))
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.decode(word.cast("binary"), "ISO-8859-1"), merged, last)

    def ids_text(self, pieces: Column, of_bytes: Column) -> Column:
        """The ids of pieces, with a space between. of_bytes: the literal of self.of_bytes."""
        of_token = lambda code: F.when(code < 256, F.get(of_bytes, code)).otherwise(F.when(code < 0xD800, code - 256).otherwise(code - 256 - 0x800))
        ids = F.transform(F.sequence(F.lit(1), F.char_length(pieces)), lambda i: let(F.ascii(F.substring(pieces, i, 1)), of_token).cast("string"))
        return F.array_join(ids, " ")

    def words(self, text: Column) -> Column:
        """The words of a text, a null one having none."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _folded(self, word: Column, tables: Column) -> Column:
        return let(self.fold(word, tables["pairs"]), lambda pieces: self.ids_text(pieces, tables["bytes"]))

    def frequent(self, documents: DataFrame, text: str = "text", most: int = FREQUENT) -> LiteralText | None:
        """Ids, as text, of the words that occur most often in all documents: of up to `most` words, those of the highest counts, as many as
        are certain to fit; counts within an eighth of a doubling go in or stay out together."""
        words = documents.select(F.explode(self.words(F.col(text))).alias("word"))
        counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.octet_length("word") <= LONGEST).where("n > 1")
        counts = materialise(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("level")))
        least, so_far = None, 0
        for level, n in sorted(((r.level, r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):  # 8 a doubling
            so_far += n
            if so_far > most:
                break
            least = level
        kept = None
        if least is not None:
            picked = counts.where(F.col("level") >= least).select("word").repartition(documents.sparkSession.sparkContext.defaultParallelism, "word")
            tables = F.struct(self.pairs.literal.alias("pairs"), self.of_bytes.alias("bytes"))
            ids = materialise(picked.select("word", let(tables, lambda t: self._folded(F.col("word"), t)).alias("ids")))
            kept = LiteralText(ids)
            forget(ids)
        forget(counts)
        return kept

    def encode(self, documents: DataFrame, text: str = "text", to: str = "ids", as_text: str | None = None, most: int = FREQUENT) -> DataFrame:
        """documents with the ids of their texts, array<int>, in column `to`, and if as_text names a column, there as decimal numbers with a space between;
        columns of these names are replaced. Null and empty texts have no ids; texts and words may be of any length, a long word taking
        as many rounds as it has different merges. most: how many of frequent()'s words are kept, which the result doesn't depend
        on. Empty tables give no rows."""
        known = self.frequent(documents, text, most)
        tables = F.struct(self.pairs.literal.alias("pairs"), self.of_bytes.alias("bytes"), *([known.literal.alias("known")] if known else []))

        def of_word(t: Column, word: Column) -> Column:
            folded = self._folded(word, t)
            return let(known.get(t["known"], word), lambda ids: F.when(ids != "", ids).otherwise(folded)) if known else folded

        (held,) = free_names(documents, "__ids") if as_text is None else (as_text,)
        found = documents.withColumn(held, F.array_join(let(tables, lambda t: F.transform(self.words(F.col(text)), lambda w: of_word(t, w))), " "))
        found = found.withColumn(to, F.from_json(F.concat(F.lit("["), F.replace(held, F.lit(" "), F.lit(",")), F.lit("]")), "array<int>"))
        return found if as_text else found.drop(held)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids, binary: their pieces one behind the other. Null for null ids and ids that no token has."""
        pieces = let(self.tokens, lambda tokens: F.transform(ids, lambda i: F.get(tokens, i)))
        return F.when(ids.isNotNull(), F.unhex(F.array_join(pieces, "", "?")))
