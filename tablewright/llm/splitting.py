"""Cutting long texts into overlapping pieces of a limited number of tokens.

Every token is written as one letter for the strongest break that the text has right behind it, so that a text becomes a
string as long as its token count. A regular expression of bounded quantifiers, strongest break first, then eats that
string up to the limit; array functions turn the matches into spans, look back for the overlap, and cut the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tokenizer import Vocabulary, _offsets, spread

#: Letters by strength: paragraph, line, sentence, word, character; X ends inside a character.
BREAKS = "PLSWCX"
_LETTERS = np.frombuffer(BREAKS.encode(), np.uint8)
_LINES = regex.compile(r"[\r\n\u2028\u2029]\s*")
_LINE_END = regex.compile(r"\r\n|[\r\n\u2028\u2029]")
_TAG_BREAK = regex.compile(r"(?:<br\s*/?>\s*){2,}|</p>|</blockquote>|<br\s*/?>", regex.I)
_SENTENCE = regex.compile(r"[.!?…。！？][\"'”’)\]]*(?=\s)")
#: Code points that str.isspace() holds for.
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
#: A character has at most four bytes and so at most four tokens.
CHAR_TOKENS = 4


def break_letters(text: str, ids: list[int], lengths: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The letter of each token, and the offsets behind it in characters and bytes (behind the last whole character, for X)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)
    ends = np.cumsum(lengths[np.asarray(ids, np.int64)])
    chars = np.cumsum(starts) - 1
    strength = np.full(len(text) + 1, 4, np.uint8)
    space = np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _SPACES)
    strength[1:-1][space[1:] != space[:-1]] = 3
    strength[np.fromiter((m.end() for m in _SENTENCE.finditer(text)), np.int64)] = 2
    for m in _TAG_BREAK.finditer(text):
        strength[m.end()] = 1 if m[0].lower().count("<") == 1 and m[0][1] in "bB" and m[0][2] in "rR" else 0
    for m in _LINES.finditer(text):
        lines = [x.end() for x in _LINE_END.finditer(m[0])]
        strength[m.start() + lines[0] : m.end() + 1] = 1
        if len(lines) > 1:
            strength[m.start() + lines[1] : m.end() + 1] = 0
    whole = starts[ends]
    at = chars[ends]
    letter = np.where(whole, strength[at], 5)
    return _LETTERS[letter].tobytes().decode(), at, np.flatnonzero(starts)[at]


def marks_column(spark, vocabulary: Vocabulary, above: int):
    """An Arrow UDF from text to (n_tokens, letters, ends, bytes); the last three are null or empty for texts of at most `above`
    tokens."""
    held = spark.sparkContext.broadcast(vocabulary)
    kind = pa.struct([("n_tokens", pa.int32()), ("letters", pa.string()), ("ends", pa.list_(pa.int32())), ("bytes", pa.list_(pa.int32()))])

    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.value
        for batch in batches:
            texts = batch.to_pylist()
            ids = v.encode_batch(texts)
            rows = [break_letters(t, x, v.lengths) if len(x) > above else (None, (), ()) for t, x in zip(texts, ids)]
            lists = lambda k: pa.ListArray.from_arrays(_offsets([r[k] for r in rows]), np.concatenate([np.zeros(0, np.int32), *(r[k] for r in rows if r[0])]).astype(np.int32))  # noqa: B023, E731
            yield pa.StructArray.from_arrays(
                [
                    pa.array(list(map(len, ids)), pa.int32()),
                    pa.array([r[0] for r in rows], pa.string()),
                    lists(1),
                    lists(2),
                ],
                fields=list(kind),
            )

    # marked as nondeterministic: a filter on the result must not evaluate it a second time
    return F.arrow_udf(mark, "struct<n_tokens: int, letters: string, ends: array<int>, bytes: array<int>>").asNondeterministic()


def cut_pattern(first: int, later: int, least: int) -> str:
    """Alternatives from the strongest break to the weakest, each as much as the limit allows: a break in the later half of
    the piece before a stronger one, then any break behind `least` tokens (an earlier one would leave a piece that the
    overlap holds whole), then the end of a character. The first match may take `first` tokens, later ones `later`."""

    def side(limit: int) -> str:
        half = limit // 2
        late = [rf"[A-Z]{{{half},{limit - 1}}}{b}" for b in "PLSW"]
        early = [rf"[A-Z]{{{min(least, half - 1)},{half - 1}}}{b}" for b in "PLSW"]
        return "|".join([rf"[A-Z]{{1,{limit}}}\z", *late, *early, rf"[A-Z]{{0,{limit - 1}}}C"])

    return rf"\A(?:{side(first)})|(?!\A)(?:{side(later)})"


def span_stops(letters: Column, limit: int, overlap: int) -> Column:
    """Where the pieces end, in tokens."""
    sizes = F.transform(F.regexp_extract_all(letters, F.lit(cut_pattern(limit, limit - overlap - (CHAR_TOKENS - 1), overlap + CHAR_TOKENS)), 0), lambda m: F.length(m))
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))


def span_start(letters: Column, stop_before: Column, overlap: int) -> Column:
    """Where the piece behind `stop_before` begins: `overlap` tokens earlier, moved back out of a character's middle."""
    at = F.greatest(stop_before - overlap, F.lit(0))
    before = F.substring(letters, F.greatest(at - (CHAR_TOKENS - 2), F.lit(1)), F.least(at, F.lit(CHAR_TOKENS - 1)))
    return at - F.length(F.regexp_extract(before, "(X*)$", 1))


def split_documents(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """(key, piece, start_token, end_token, start_char, end_char, n_tokens, doc_tokens, text) of each text above the limit.

    Pieces are spans of the text's own tokens: each has at most `limit`, each begins `overlap` tokens before the end of the
    one before it (up to three more, where that point lies inside a character), and together they cover the text. Texts of
    at most `limit` tokens, empty and null ones have no pieces. Rows with equal keys are cut each for itself. Other columns
    are left out.
    """
    if not 0 <= overlap < limit - 2 * CHAR_TOKENS:
        raise ValueError("the overlap must be well below the limit")
    use = marks_column(docs.sparkSession, vocabulary, limit)
    rows = spread(docs.select(F.col(key), F.col(text).alias("_text"))).select(key, "_text", use("_text").alias("m")).where(F.col("m.letters").isNotNull())
    stops = rows.select(key, F.col("_text").cast("binary").alias("_raw"), "m.n_tokens", "m.letters", "m.ends", "m.bytes", span_stops(F.col("m.letters"), limit, overlap).alias("stops"))
    behind = lambda offsets, token: F.when(token == 0, F.lit(0)).otherwise(F.get(offsets, token - 1))

    def piece(stop: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(span_start(F.col("letters"), F.get("stops", i - 1), overlap))
        return F.struct(i.cast("int").alias("piece"), start.alias("start_token"), stop.alias("end_token"))

    def cut(p: Column, raw: Column) -> Column:
        a, b = p["start_token"], p["end_token"]
        first = behind(F.col("bytes"), a)
        # bytes are reached directly, characters would be counted from the start of the text for every piece
        text = F.substring(raw, first + 1, behind(F.col("bytes"), b) - first).cast("string")
        return F.struct(p["piece"], a, b, behind(F.col("ends"), a).alias("start_char"), behind(F.col("ends"), b).alias("end_char"), text.alias("text"))

    # a piece takes along its own span and text, and nothing of the whole text; as the variable of an outer function the text is
    # read once, as a column it would be copied out of its row for every piece
    pieces = F.get(F.transform(F.array("_raw"), lambda raw: F.transform(F.transform("stops", piece), lambda p: cut(p, raw))), F.lit(0))
    # every text here has a piece; a plain explode would have its input's size asked for below, and all of this computed for that
    cuts = stops.select(key, "n_tokens", pieces.alias("_pieces")).select(key, F.col("n_tokens").alias("doc_tokens"), F.explode_outer("_pieces").alias("p"))
    return cuts.select(key, "p.piece", "p.start_token", "p.end_token", "p.start_char", "p.end_char", (F.col("p.end_token") - F.col("p.start_token")).alias("n_tokens"), "doc_tokens", "p.text")
