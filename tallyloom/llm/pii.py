"""Problem 9: personal information in free text, by bootstrapped contextual extraction.

One pass over the texts emits candidate spans (e-mail, number, name and address shapes) with the words around them. Seeds
are only what could be nothing else: undisguised e-mail addresses, numbers with a country code, identity numbers of two
published formats, streets and boxes with a postcode behind them, and the given and family names that e-mail addresses of
the form given.family@domain spell. Candidates are counted into a bipartite graph of patterns (words before or after) and
instances (name parts; shapes of numbers and of the local parts of addresses; street words with what follows them). Spark
scores it in rounds: a pattern's confidence in a type is the share of its occurrences held by instances of that type, an
instance's is the mean of its patterns'; seeds and what was promoted stay at one, and rounds end when promotions do. Spans
whose patterns and instances agree are kept, so that identifiers no seed resembles are found by where they stand.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, small

#: Rounds end once a round promotes less than this share of the instances that are certain.
SETTLED = 0.001
#: Occurrences a pattern or instance is assumed to have besides those seen, all untyped.
PRIOR = 2.0
ACCEPT = 0.5
#: A name needs both: its parts known as parts of names and a place where names stand (geometric mean).
ACCEPT_NAME = 0.4
#: Mean confidence of an instance's patterns from which it is taken as known.
PROMOTE = 0.4
TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

_U = "A-ZÀ-ÖØ-ÞŁŚŹŻĆŃČŠŽĐŐŰĞİ"
_WS = r"(?:[^\S\n]+\n?[^\S\n]*|\n[^\S\n]*)"
_W = rf"[{_U}][^\W\d_]{{2,}}"
_PARTICLE = r"(?:von|van|de|la|del|della|der|den|di|da|dos|du|zu|ten|ter|el|al|bin|ibn)"
_FAMILY = rf"{_W}(?:-{_W})?"
_INITIALS = rf"[{_U}]\.(?:{_WS}?[{_U}]\.)*"
# first letters are outside the groups, so that the search can skip to capitals
_NAME = re.compile(
    rf"[{_U}](?:(?P<g>[^\W\d_]{{2,}}|\.(?:{_WS}?[{_U}]\.)*){_WS}(?:{_PARTICLE}(?:{_WS}|(?<=al)-|(?<=el)-))*(?P<f>{_FAMILY})|(?P<f2>[^\W\d_]{{2,}}(?:-{_W})?),{_WS}(?P<g2>{_W}|{_INITIALS}))(?![\w])"
)
_BEFORE = re.compile(rf"(?<![\w.-])(?:{_PARTICLE}{_WS})+\Z")
_MISTER = re.compile(rf"[^\S\n]+(?:{_PARTICLE}{_WS}|al-|el-)*{_W}|,{_WS}{_W}(?=,|{_WS}[^\W\d_A-Z])|(?:-{_W})?, titulaire")
_EMAIL_HINT = re.compile(r"@|[(\[{]\s?[aA][tT]\s?[)\]}]")
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?:{_DOT}[A-Za-z0-9_+-]+)*\s?(?:@|[(\[{{]\s?(?:at|AT)\s?[)\]}}])\s?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w])")
_NUMBER = re.compile(
    r"(?<![\w/:.+-])(?:\+\d(?:[\s.-]?(?:\(\d{1,4}\)|\d)){6,14}|\(\d{2,5}\)[\s.-]?\d{3,4}[\s.-]\d{3,4}|[A-Z]{2}-?\d{6,9}(?:-?[A-Z])?|[A-Z]{2}\s?\d{2}\s\d{2}\s\d{2}\s?[A-Z]|0\d{2,5}/\d{3,8}(?:-\d{1,5})?|\d{9,14}|\d+(?:[\s.-]\(0\)\d+)?(?:[\s.-]\d+){1,6})(?![\w/:]|[.,]\d)"
)
# Words that streets are called by, and what stands before a box or plot.
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Crescent|Drive|Dr\.?|Boulevard|Blvd\.?|Way|Court|Ct\.?|Place|Square|Close|Terrace)"
_TOWN = rf"{_W}(?:[- ]{_W})*"
_AREA = rf"(?:{_TOWN},?{_WS}(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|[A-Z]{{2}}\s\d{{4,6}}|\d{{4,6}})|\d{{4,6}}{_WS}{_TOWN}|{_TOWN})"
_CODED = rf"(?:{_TOWN},?{_WS}(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|[A-Z]{{2}}\s\d{{4,6}}|\d{{4,6}})|\d{{4,6}}{_WS}{_TOWN})"  # with a postcode
_POSTED = re.compile(rf"{_CODED}\Z")
_SEP = rf"(?:,{_WS}?|\n[^\S\n]*)"
_FLAT = rf"(?:{_SEP}(?:Apt\.?|Flat|Unit|Suite|Sector|Block)\s?\w+|{_SEP}\d{{1,2}}[ºª°]\w?)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?P<box>P\.\s?O\.\s?Box|PO\sBox|Postfach|Apartado|B\.P\.){_WS}\d+|(?P<plot>Plot|Unit|Flat|House){_WS}\d+\w?(?={_SEP}(?:Sector|Block|Phase))"
    rf"|\d{{1,5}}[a-z]?(?:{_WS}(?:bis|ter))?,?{_WS}(?P<rue>rue|avenue|boulevard|place|chemin|all[ée]e|quai){_WS}(?:(?:du|de{_WS}la|de|des){_WS})?(?:[dl]['’])?{_TOWN}"
    rf"|(?P<calle>Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Via|Viale){_WS}(?:(?:de|del|la){_WS})*{_W}(?:{_WS}{_W})?,?{_WS}\d{{1,5}}\w?"
    rf"|{_W}?[^\W\d_]*(?P<str>stra(?:ße|sse)|str\.|gasse|weg|platz|allee|ring|damm|ufer){_WS}\d{{1,5}}(?:{_WS}?[a-z])?(?![\w])"
    rf"|\d{{1,5}}[A-Za-z]?{_WS}(?:(?:North|South|East|West|[NSEW]\.){_WS})?{_W}(?:{_WS}{_W})?{_WS}(?P<st>{_STREET})(?![\w]))"
    rf"{_FLAT}?(?:,{_WS}?{_AREA}|\n[^\S\n]*(?:{_CODED}(?![\w])|{_AREA}(?=\s*(?:[.,;)\n]|$))))?(?![\w])"
)
_CUES = ("Box", "Postfach", "Apartado", "B.P.", "Plot", "Unit", "Flat", "House", " rue ", " avenue ", " boulevard ", " place ", " chemin ", "allée ", "allee ", " quai ", "Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Via ", "Viale",
         "straße", "strasse", "str.", "gasse", "weg ", "platz ", "ring ", "damm ", "ufer ", "Street", " St", "Road", " Rd", "Avenue", "Ave", "Lane", " Ln", "Crescent", "Drive", " Dr", "Boulevard", "Blvd", " Way", "Court", " Ct", "Place", "Square", "Close", "Terrace")
_SIGN = re.compile(r"\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?", re.I)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
_FRENCH = re.compile(r"\b(?:est|une|dans|pour|avec|sont|les?|des?|la|du|sur|ou|été)\b")
_DIGITS = re.compile(r"\d[\d\s().\-/]{4,}\d")
_AT = ("@", "(at", "[at", "{at", "( at", "[ at", "(AT", "[AT", "{AT", "( AT", "[ AT")
_TOKEN = re.compile(r"[^\W\d_]+\.?|\d|[^\w\s]")
_TITLES = {"dr.", "prof.", "ms.", "mr.", "mrs.", "ing.", "m.", "mme", "sr.", "sra.", "herr", "frau", "dipl.-"}


def fold(s: str) -> str:
    """Lower case without marks, Ł as l."""
    s = s.lower().replace("ł", "l").replace("ß", "ss")
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def shape(s: str) -> str:
    return re.sub(r"\s", " ", re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", s)))


def _around(text: str, a: int, b: int) -> tuple[str, str, str, str]:
    """The last one and two tokens before a span and the first one and two after it; a token at a window's edge may be cut, hence the third."""
    n = 28
    while len(before := _TOKEN.findall(text[max(0, a - n) : a].lower())) < 3 and n < a:
        n *= 2
    n = 22
    while len(after := _TOKEN.findall(text[b : b + n].lower())) < 3 and b + n < len(text):
        n *= 2
    before, after = before[-2:], after[:2]
    line = "^" if a == 0 or text[a - 1] == "\n" else ""
    return line + (before[-1] if before else ""), " ".join(before), after[0] if after else "", " ".join(after)


def _local_shape(mail: str) -> str:
    """An e-mail address by the shape of its local part and the way its sign is written."""
    sign = _SIGN.search(mail)
    local = re.sub(r"\d+", "9", re.sub(r"[A-Za-z]+", "a", re.sub(r"\s?[(\[{]\s?dot\s?[)\]}]\s?", ".", mail[: sign.start()], flags=re.I)))
    return local + ("@" if sign.group() == "@" and "(" not in mail and "[" not in mail else " @ " if "@" in sign.group() else "(at)")


def candidates(text: str) -> list[tuple]:
    """(kind, start, span, L1, L2, R1, R2, key1, key2, seed1, seed2) of all spans with the shape of personal information."""
    out = []

    def add(kind: str, a: int, b: int, k1: str, k2: str, s1: str | None = None, s2: str | None = None) -> None:
        out.append((kind, a, text[a:b], *_around(text, a, b), k1, k2, s1, s2))

    taken: list[tuple[int, int]] = []
    last = 0
    for h in _EMAIL_HINT.finditer(text) if any(x in text for x in _AT) else ():
        if h.start() < last:
            continue
        n = 70
        while True:  # until the match does not touch the window
            lo, hi = max(last, h.start() - n), min(len(text), h.end() + n)
            while lo > last and text[lo - 1] in _LOCAL:
                lo -= 1
            while hi < len(text) and text[hi] in _LOCAL:
                hi += 1
            m = next((x for x in _EMAIL.finditer(text, lo, hi) if x.end() > h.start()), None)
            if hi == len(text) or not m or m.end() < hi - 12:  # a spelt dot is shorter
                break
            n *= 2
        last = h.end()  # no local part holds a sign
        if m and m.start() < h.start():
            last = m.end()
            taken.append(m.span())
            mail = m.group()
            key = _local_shape(mail)
            add("email", *m.span(), key, "", "EMAIL" if key[-1] == "@" else None)
    spots = []
    for cue in _CUES:
        q = text.find(cue)
        while q >= 0:
            spots.append(q)
            q = text.find(cue, q + 1)
    last = 0
    for q in sorted(spots):
        if q < last:
            continue
        n = 48
        while True:  # at least six words before the cue, and no cut at either end
            lo, hi = max(last, q - n), min(len(text), q + 160 + n)
            m = _ADDRESS.search(text, lo, hi)
            cut_left = lo > last and (m.start() <= lo + 1 if m else text.count(" ", lo, q) + text.count("\n", lo, q) < 6)
            if not cut_left and not (m and m.end() == hi < len(text)):
                break
            n *= 2
        if not m:
            continue
        last = m.end()
        kind = next(k for k in ("box", "plot", "rue", "calle", "str", "st") if m.group(k))
        taken.append(m.span())
        whole = _POSTED.search(m.group(), m.end(kind) - m.start()) is not None
        add("address", *m.span(), f"w:{fold(m.group(kind))}:{'posted' if whole else 'bare'}", "", "ADDRESS" if whole and kind in ("box", "rue", "st", "str") else None)
    taken.sort()
    at = 0
    last = 0
    for m in (x for d in _DIGITS.finditer(text) for x in _NUMBER.finditer(text, max(0, d.start() - 6), min(len(text), d.end() + 6))):
        a, b = m.span()
        if a < last:
            continue
        last = b
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        s = m.group()
        digits = sum(map(str.isdigit, s))
        if not 6 <= digits <= 15 or (digits == 6 and not s[0].isalpha()):
            continue
        sh = shape(s)
        seed = "PHONE" if s[0] == "+" else "ID_NUMBER" if re.fullmatch(r"AA ?99 ?99 ?99 ?A|999-99-9999", sh) else None
        add("number", a, b, sh, "", seed)
    at = pos = 0
    while m := _NAME.search(text, pos):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_.°-"):
            pos = a + 1
            continue
        pos = b
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        first = m.group("g")
        given, family = (text[a : m.end("g")], m.group("f")) if first else (m.group("g2"), text[a : m.end("f2")])
        if first and given.endswith("M.") and _MISTER.match(text, b):  # a title, not an initial
            pos = m.end("g")
            continue
        if first and re.match(r"M\.\s", given) and len(given) > 3 and len(_FRENCH.findall(text[max(0, a - 150) : b + 150])) >= 4:  # in French text the first initial is a title
            a += len(given) - len(given[2:].lstrip())
            given = text[a : m.end("g")]
        if first:  # the first word may only begin a sentence: the name may start at the second
            pos = m.start("f")
        elif before := _BEFORE.search(text, max(0, a - 16), a):
            a = before.start() if before.group().lower().split() != ["de"] else a  # by itself a preposition
        if at < len(taken) and taken[at][0] < b:
            continue
        g = "#" if given[1] == "." else fold(given)
        add("name", a, b, f"g:{g}", f"f:{fold(family).split('-')[-1].split()[-1]}")
    return out


_COLUMNS = ["kind", "start", "span", "l1", "l2", "r1", "r2", "k1", "k2", "s1", "s2"]
_SCHEMA = "doc_id bigint, kind string, start int, span string, l1 string, l2 string, r1 string, r2 string, k1 string, k2 string, s1 string, s2 string"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, *c) for i, t in zip(b["doc_id"], b["text"], strict=True) for c in candidates(t)]
        yield pd.DataFrame(rows, columns=["doc_id", *_COLUMNS])


def _edges(found: DataFrame) -> DataFrame:
    """kind, pattern, k1, k2, n: the occurrences of instances (one or two keys) beside patterns."""
    patterns = F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("l1", "l2", "r1", "r2")])
    counted = found.groupBy("kind", "l1", "l2", "r1", "r2", "k1", "k2").agg(F.count("*").alias("n"))
    return counted.select("kind", F.explode(patterns).alias("pattern"), "k1", "k2", "n").groupBy("kind", "pattern", "k1", "k2").agg(F.sum("n").alias("n"))


def _seeds(found: DataFrame) -> DataFrame:
    """kind, instance, type of seeds: typed keys, and name parts that plain e-mail addresses spell as given.family."""
    own = found.where("s1 is not null").select("kind", F.col("k1").alias("instance"), F.col("s1").alias("type")).distinct()
    parts = F.split(F.lower(F.regexp_extract("span", r"^([A-Za-z]{3,}\.[A-Za-z]{3,})@", 1)), r"\.")
    spelt = found.where("kind = 'email' and k1 = 'a.a@'").select(parts.alias("p")).where("size(p) = 2").select(F.explode(F.array(F.concat(F.lit("g:"), F.col("p")[0]), F.concat(F.lit("f:"), F.col("p")[1]))).alias("instance")).distinct()
    initials = found.sparkSession.range(1).select(F.lit("g:#").alias("instance"))  # say nothing against a name
    return own.unionByName(spelt.unionByName(initials).select(F.lit("name").alias("kind"), "instance", F.lit("NAME").alias("type")))


def score_graph(edges: DataFrame, seeds: DataFrame, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) with their confidence in each type: kind, pattern or instance, type, c.

    An occurrence counts for its pattern by the lesser confidence of its keys; an instance above PROMOTE becomes and stays
    certain, so that the rounds end.
    """
    held = cut(seeds.withColumn("c", F.lit(1.0)))
    # instances are judged by the longer contexts only
    ends = edges.where(F.col("pattern").rlike("^[lr]2=")).select("kind", "pattern", F.explode(F.filter(F.array("k1", "k2"), lambda x: x != "")).alias("instance"), "n")
    ends = cut(ends.groupBy("kind", "pattern", "instance").agg(F.sum("n").alias("n")))
    total_p = cut(edges.groupBy("kind", "pattern").agg(F.sum("n").alias("t")))
    total_i = cut(ends.groupBy("kind", "instance").agg(F.sum("n").alias("t")))
    instances = held
    certain = held.count()
    while True:
        one = instances.select("kind", F.col("instance").alias("k1"), "type", F.col("c").alias("c1"))
        two = instances.select("kind", F.col("instance").alias("k2"), "type", F.col("c").alias("c2"))
        heard = edges.join(small(one), ["kind", "k1"])
        heard = heard.where("k2 = ''").withColumn("c", F.col("c1")).select("kind", "pattern", "type", "n", "c").unionByName(heard.where("k2 <> ''").join(small(two), ["kind", "k2", "type"]).select("kind", "pattern", "type", "n", F.least("c1", "c2").alias("c")))
        patterns = heard.groupBy("kind", "pattern", "type").agg(F.sum(F.col("n") * F.col("c")).alias("m")).join(small(total_p), ["kind", "pattern"]).select("kind", "pattern", "type", (F.col("m") / (F.col("t") + PRIOR)).alias("c"))
        patterns = cut(patterns.where("c > 0.05"))
        told = ends.join(small(patterns.where("c > 0.3")), ["kind", "pattern"]).groupBy("kind", "instance", "type").agg(F.sum(F.col("n") * F.col("c")).alias("m")).join(small(total_i), ["kind", "instance"]).select("kind", "instance", "type", (F.col("m") / (F.col("t") + PRIOR)).alias("c"))
        told = told.where("c > 0.05").withColumn("c", F.when(F.col("c") >= PROMOTE, 1.0).otherwise(F.col("c")))
        instances = cut(told.unionByName(instances.where("c = 1")).groupBy("kind", "instance", "type").agg(F.max("c").alias("c")))
        now = instances.where("c = 1").count()
        if now - certain <= settled * certain:
            return patterns, instances
        certain = now


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """doc_id, start, pii_type, pii_text, confidence: personal information in each document, spans as they stand there.

    start counts characters from 0. Null and empty texts hold none; repeated documents give repeated rows; empty tables
    give none. Spans of one kind never overlap; a name inside an address is part of the address.
    """
    docs = documents.where(F.length(text) > 0).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = cut(docs.mapInPandas(_scan, _SCHEMA))
    edges = cut(_edges(found))
    patterns, instances = score_graph(edges, _seeds(found))
    best = lambda df, key: df.groupBy("kind", key).agg(F.map_from_entries(F.collect_list(F.struct("type", "c"))).alias("cs"))  # noqa: E731 (at most five types)
    by_pattern, by_instance = cut(best(patterns, "pattern")), cut(best(instances, "instance"))
    x = found
    for c in ("l1", "l2", "r1", "r2"):
        p = by_pattern.where(F.startswith("pattern", F.lit(f"{c}="))).select(F.col("kind").alias("_k"), F.substring("pattern", 4, 999).alias("_p"), F.col("cs").alias(f"c_{c}"))
        x = x.join(small(p), (F.col("kind") == F.col("_k")) & (F.col(c) == F.col("_p")), "left").drop("_k", "_p")
    for c in ("k1", "k2"):
        i = by_instance.select(F.col("kind").alias("_k"), F.col("instance").alias("_i"), F.col("cs").alias(f"c_{c}"))
        x = x.join(small(i), (F.col("kind") == F.col("_k")) & (F.col(c) == F.col("_i")), "left").drop("_k", "_i")
    at = lambda col, t: F.coalesce(F.try_element_at(F.col(col), F.lit(t)), F.lit(0.0))

    def confidence(t: str):
        left, right = F.greatest(at("c_l1", t), at("c_l2", t)), F.greatest(at("c_r1", t), at("c_r2", t))
        one, two = at("c_k1", t), at("c_k2", t)
        inner = F.when(F.col("k2") == "", one).otherwise(F.least(one, two))
        return F.when(F.col("kind") == "name", F.sqrt(inner * F.greatest(left, right))).otherwise(inner * 0.6 + F.greatest(left, right) * 0.4)

    scores = F.array(*[F.struct(confidence(t).alias("c"), F.lit(t).alias("t")) for t in TYPES])
    x = x.withColumn("_best", F.array_max(scores)).where((F.col("_best.c") >= F.when(F.col("kind") == "name", F.lit(min(accept, ACCEPT_NAME))).otherwise(F.lit(accept))) & ~((F.col("kind") == "name") & (F.col("r1") == "&")))
    x = x.select("doc_id", "start", F.col("_best.t").alias("pii_type"), F.col("span").alias("pii_text"), F.col("_best.c").alias("confidence"), (F.col("start") + F.length("span")).alias("_end"))
    # of overlapping spans the surer stays, then the longer
    w = Window.partitionBy("doc_id").orderBy("start", "_end")
    rank = F.struct("confidence", (F.col("_end") - F.col("start")).alias("n"))
    beaten = (F.lag("_end").over(w) > F.col("start")) & (F.lag(rank).over(w) > rank) | (F.lead("start").over(w) < F.col("_end")) & (F.lead(rank).over(w) > rank)
    return x.withColumn("_beaten", F.coalesce(beaten, F.lit(False))).where("not _beaten").drop("_beaten", "_end")


def replace_pii(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with each found span replaced by its type in square brackets; other columns stay. found: from find_pii.

    A document's spans are gathered into one row; if those rows are few enough to broadcast (session.small) no text is shuffled,
    beyond that texts meet their spans by doc_id. Of overlapping spans the first
    and then the longest is replaced. Documents without spans, null texts included, pass as they are.
    """
    spans = cut(found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", (-F.length("pii_text")).alias("n"), "pii_type"))).alias("_spans")))
    x = documents.join(small(spans), F.col(doc_id) == F.col("_id"), "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None or s is None:
                out.append(t)
                continue
            parts, at = [], 0
            for q in s:
                if q["start"] >= at:
                    parts += [t[at : q["start"]], f"[{q['pii_type']}]"]
                    at = q["start"] - q["n"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return x.withColumn(text, masked(F.col(text), F.col("_spans"))).select(*documents.columns)
