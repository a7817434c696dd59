"""Problem 8: evaluation passages inside training documents, by winnowed fingerprints and extension of the hits.

Texts become words without case, punctuation, markup, line-break hyphens, look-alike characters and the commonest misread
letters. Of a document, the least hash of k words in each window of w positions is kept (winnowing); of a test item all of
them, so that any k + w - 1 words in a row that both share meet in at least one fingerprint. A bitmap of fixed size over
the test fingerprints drops nearly all others inside the scan; what is left, each with the words around it, is joined with
the table of test fingerprints. Pairs whose surroundings agree name the documents that are read once more, where hits are
extended by local alignment, which admits replaced, misread and inserted words. No text is shuffled while the test side or
the list of hit documents is below the checked bound of a broadcast; beyond it both joins are ordinary ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, small

K = 4
WINDOW = 2
#: Words of an item that a passage must cover; its first and last may be altered ones, hence EDGE.
LEAST_WORDS = 20
EDGE = 1
#: Bits of the bitmap over test fingerprints: 16 MB at any size of the test side.
BITMAP_BITS = 1 << 27
#: Rows of the fingerprint table that may be broadcast; a row is about 180 bytes.
PRINTS_ROWS = 200_000
#: Words before and after a fingerprint that must agree with it, and how many of them.
BACK, AHEAD, AGREE = 14, 18, 14
#: Widest alignment whose score, matches and first word fit in one integer.
MOST_WORDS = 1 << 20

# Letters of other scripts by the Latin letters they look like.
LOOK_ALIKE = str.maketrans(
    "авекмнорстухіјѕԁԛԝһӏαεικνορτυχγϲ",
    "abekmhopctyxijsdqwhlaeiknoptuxyc",
)
_MARKUP = re.compile(r"</?(?:b|i|u|em|strong|sub|sup|span|font|a|tt|mark)(?: [^<>]{0,80})?>", re.I)
_TAG = re.compile(r"<[^<>\n]{1,80}>|&(?:nbsp|amp|lt|gt|quot|shy|zwnj);|\\(?:textbf|textit|emph|mathrm|text)\b")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SEEN_HIDDEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_BREAK = re.compile(r"[-‐‑][^\S\n]*\n\s*(?=[^\W\d_])")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Comparable words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if any(c in text for c in _SEEN_HIDDEN):
            text = _HIDDEN.sub("", text)
    if "<" in text or "&" in text or "\\" in text:
        text = _TAG.sub(" ", _MARKUP.sub("", text))
    if "-\n" in text or "- \n" in text or "‐" in text or "‑" in text:
        text = _BREAK.sub("", text)
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(LOOK_ALIKE)
    # misread letters fall together
    text = text.replace("rn", "m").replace("1", "l").replace("i", "l").replace("0", "o").replace("c", "e").replace("5", "s")
    return _WORD.findall(text)


_M = np.uint64(0x9E3779B97F4A7C15)


def grams(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of k ids in a row."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ x[j : j + n]) * _M
            h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window (the last of equals)."""
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, int)
    if w == 2:
        at = np.arange(len(h) - 1) + (h[1:] <= h[:-1])
        return at[np.concatenate([[True], at[1:] != at[:-1]])]
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.arange(len(views)) + (w - 1 - np.argmin(views[:, ::-1], axis=1))
    return at[np.concatenate([[True], at[1:] != at[:-1]])]  # positions never go back


class WordHash(dict):
    """Words to positive 31-bit hashes, kept while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = (xxhash.xxh32_intdigest(word) >> 1) | 1
        return h


def item_words(text: str, hashes: WordHash) -> tuple[list[int], list[int]]:
    """Word hashes of a test item, and for each the number of the blank-separated word it stands in."""
    words, raw = [], []
    for r, piece in enumerate((text or "").split()):
        for x in words_of(piece):
            words.append(hashes[x])
            raw.append(r)
    return words, raw


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHash()
    for b in batches:
        both = [item_words(t, hashes) for t in b["text"]]
        yield pd.DataFrame({"item_id": b["item_id"], "words": [w for w, _ in both], "raw": [r for _, r in both]})


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every fingerprint of the items with the words around it."""
    for b in batches:
        for item, words in zip(b["item_id"], b["words"], strict=True):
            w = np.asarray(words, np.int64)
            h = grams(w)
            if len(h):
                around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(BACK, -1), w, np.full(AHEAD, -1)]), BACK + AHEAD)[: len(h)]
                yield pd.DataFrame({"g": h.view(np.int64), "item_id": item, "p": np.arange(len(h)), "beside": _cells(around)})


def _ids(text: str, hashes: WordHash) -> np.ndarray:
    return np.fromiter([hashes[w] for w in words_of(text)], np.int64)


def _cells(rows: np.ndarray) -> list[bytes]:
    """Each row of 32-bit numbers as bytes, which travel cheaper than lists."""
    data, width = rows.astype(np.int32).tobytes(), rows.shape[1] * 4
    return [data[i : i + width] for i in range(0, len(data), width)]


def _rows(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int32).reshape(len(cells), -1)


def text_hits(texts: list[np.ndarray], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, fingerprint, place, words around) of the texts' winnowed fingerprints that the bitmap admits."""
    gap = np.zeros(BACK + AHEAD + 4, np.int64)
    flat = np.concatenate([gap, *(x for ids in texts for x in (ids, gap))])
    begin = np.cumsum([len(gap), *(len(ids) + len(gap) for ids in texts[:-1])])
    h = grams(flat)
    keep = winnow(h)
    low = h[keep] & np.uint64(BITMAP_BITS - 1)
    keep = keep[(bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    keep = keep[(flat[keep] > 0) & (flat[keep + K - 1] > 0)]  # no gap within
    text = np.searchsorted(begin, keep, "right") - 1
    around = np.lib.stride_tricks.sliding_window_view(flat, BACK + AHEAD + 4)[keep - BACK - 2]
    return text, h[keep].view(np.int64), keep - begin[text], around


def agreeing(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many words of each item window agree with the text's on the hit's diagonal or up to two beside it."""
    agree = np.zeros(item.shape, bool)
    for shift in range(5):
        agree |= doc[:, shift : shift + BACK + AHEAD] == item
    return agree.sum(axis=1)


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (match 1, else -2): first and last item word it covers and the number of matches.

    A cell holds score, matches and first word packed in one integer, so that one maximum carries all three.
    Items of MOST_WORDS words or more are refused with an error.
    """
    n, m = len(item), len(doc)
    if n >= MOST_WORDS:
        raise ValueError(f"a test item of {n} words; split items beyond {MOST_WORDS - 1}")
    unit, many = np.int64(1 << 41), np.int64(1 << 20)  # 21 bits of matches above 20 of the first word
    step = np.arange(m + 1, dtype=np.int64) * (2 * unit)
    prev = np.zeros(m + 1, np.int64)
    best, where = np.int64(0), -1
    for i in range(n):
        cur = np.zeros(m + 1, np.int64)
        fresh = np.int64(n - i)  # an alignment that begins here; an earlier first word sorts higher
        np.add(np.where(prev[:-1] >= unit, prev[:-1], fresh), np.where(doc == item[i], unit + many, -2 * unit), out=cur[1:])
        np.maximum(cur, prev - 2 * unit, out=cur)
        cur = np.maximum.accumulate(cur + step) - step  # inserted words
        top = cur.max()
        if top > best:
            best, where = top, i
        prev = cur
    if where < 0 or best < unit:
        return 0, -1, 0
    return n - int(best & (many - 1)), where, int((best >> 20) & ((1 << 21) - 1))


def best_alignment(item: np.ndarray, doc: np.ndarray, corners: list[int]) -> tuple[int, int, int]:
    """The alignment of most words over the diagonals where hits were (each the text place of the item's first word)."""
    n, out, done = len(item), (0, -1, 0), None
    for c in sorted(corners):
        if done is not None and c - done < 16:
            continue
        done = c
        lo, hi = max(0, c - 40), min(len(doc), c + n + n // 3 + 40)
        got = align(item, doc[lo:hi]) if hi > lo else out
        if got[1] - got[0] > out[1] - out[0]:
            out = got
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, doc_id, covered, share: items of which a document holds least_words words in a row, near enough.

    covered counts the item's words from first to last; share is the part of them found. Null and empty texts leak
    nothing; items shorter than least_words can't leak; repeated rows of a document give one row. Empty tables give none.
    """
    schema = "item_id bigint, doc_id bigint, covered int, share double"
    spark = documents.sparkSession
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).groupBy(F.col(item_id).cast("bigint").alias("item_id")).agg(F.min(text).alias("text"))
    held = cut(rows.mapInPandas(_items, "item_id bigint, words array<int>, raw array<int>"))
    prints = cut(held.select("item_id", "words").mapInPandas(_prints, "g bigint, item_id bigint, p int, beside binary"))
    # one row a 32,768 fingerprint values, 4,096 rows at most
    low = f"(g & {BITMAP_BITS - 1})"
    bits = prints.groupBy(F.expr(f"{low} div 32768").alias("at")).agg(F.expr(f"bitmap_construct_agg({low} % 32768)").alias("bits")).collect()
    bitmap = bytearray(BITMAP_BITS // 8)
    for at, b in bits:
        bitmap[at * 4096 : (at + 1) * 4096] = b
    sent = spark.sparkContext.broadcast(bytes(bitmap))
    docs = documents.where(F.length(text) > 0).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, table = WordHash(), np.frombuffer(sent.value, np.uint8)
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), b["text"].tolist()
            for a in range(0, len(texts), 128):
                text, g, at, around = text_hits([_ids(t, hashes) for t in texts[a : a + 128]], table)
                yield pd.DataFrame({"doc_id": ids[a + text], "h": g, "at": at, "around": _cells(around)})

    @F.pandas_udf("boolean")
    def near(doc: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series(agreeing(_rows(doc), _rows(item)) >= AGREE if len(doc) else [], dtype=bool)

    met = docs.mapInPandas(scan, "doc_id bigint, h bigint, at int, around binary").join(small(prints, PRINTS_ROWS), F.col("h") == F.col("g"))
    met = met.where(near("around", "beside")).select("doc_id", "item_id", (F.col("at") - F.col("p")).alias("corner"))
    pairs = met.groupBy("doc_id", "item_id").agg(F.collect_set("corner").alias("corners")).join(small(held, PRINTS_ROWS), "item_id")
    # what one document leaks is bounded by its own length
    wanted = cut(pairs.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("item_id", "corners", "words", "raw")).alias("pairs")))
    again = docs.join(small(wanted, 50_000), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "pairs")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            found = []
            for i, t, some in zip(b["doc_id"].tolist(), b["text"], b["pairs"], strict=True):
                ids = _ids(t, hashes)
                for q in some:
                    first, last, matched = best_alignment(np.asarray(q["words"], np.int64), ids, list(q["corners"]))
                    if last >= first:
                        found.append((q["item_id"], i, int(q["raw"][last] - q["raw"][first] + 1), matched / (last - first + 1)))
            yield pd.DataFrame(found, columns=["item_id", "doc_id", "covered", "share"])

    got = again.mapInPandas(extend, schema).where(F.col("covered") >= least_words - EDGE)
    return got.groupBy("item_id", "doc_id").agg(F.max("covered").alias("covered"), F.max("share").alias("share"))
