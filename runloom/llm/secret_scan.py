"""Secret scan: fixed patterns, and a battery of randomness tests on other tokens.

Tokens are maximal runs of 20 or more of A-Za-z0-9+/_=-. Each has its encoding
inferred: hex, base32, one-case alphanumeric or base64; a token of digits
alone or of letters of one case alone has none and is not tested. The battery
has four deviates for a token: chi-squared on the symbols of its alphabet, the
Wald-Wolfowitz runs test on symbols above and below the alphabet's middle, a
runs test on classes (lower case, upper case, digit, other), and the lag-1
serial correlation. It is read in two ways:

* Could the token be uniformly random? Each test rejects at a quarter of ALPHA.
* Could it be an ordinary identifier? What the deviates are for ordinary
  identifiers of the encoding and length is simulated here, from words, numbers
  and the usual ways to join them. They are combined into the one that best
  tells random tokens from those (a linear discriminant, scaled to the ordinary
  tokens' upper tail), which is a normal deviate for them.

The second question is asked of every token of the corpus, so the combined
deviates pass a Benjamini-Hochberg step at level FDR within each class of
lengths: long and short tokens have different power and don't lend each other
evidence. The step needs only counts of deviates in bins of 0.05. A token is a
finding if randomness isn't rejected and its deviate passes; it is added
unless it lies in a span that the fixed patterns have found.

DataFrame functions only. Work on a text is linear in its matches (up to
blocks of 128 of them), whatever its length. Null text is an empty text and
has no spans. Repeated rows are judged each; an empty table gives no rows;
further columns don't matter.
"""

from __future__ import annotations

import math
import random
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import common
from runloom.llm.common import let as _let
from runloom.llm.common import stored
from runloom.llm.common import walked as _walked

#: The patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

ALPHA = 1e-4
FDR = 0.01
LENGTHS = (20, 32, 48, 80)
BIN = 0.05
TOP_BIN = 2000

#: Lengths at which ordinary identifiers are simulated, and how many of each encoding.
NODES = (20, 24, 28, 32, 40, 48, 64, 96)
SIMULATED = 4000
#: Parts of ordinary identifiers.
WORDS = "account action active address admin array asset async background base batch binary block board body border bottom bucket buffer build button byte cache callback cancel card change channel check child class clear click client close code collection color column command comment common compare component config connect constant container content context control copy core count create current custom data date debug default delete demo detail device dialog directory display document domain download driver edit element email enable end engine entity entry error event example exception execute export expression factory false feature field file filter final find first flag folder font form format frame function general generic get global graph group handle handler hash header height helper hidden history home host icon image import index info init inner input insert instance integer interface internal item iterator job key label language last layer layout length level library limit line link list listener load local lock logger login main manager map mark master matrix max memory menu message meta method model module monitor mouse name native network new next node null number object offset open operation option order output package page panel parent parser password path pattern payment performance permission picture platform player plugin pointer policy position post prefix previous private process product profile project property protocol provider proxy public query queue random range read record region register release remote remove render replace report request resource response result return right role root route row rule sample schema scope screen script search section select server service session set setting shader shared signal simple single size socket source space spec start state static status step storage store stream string style summary support switch symbol sync system table tag target task template test text thread time title token tool top total trace track transfer tree trigger type unique update upload user utility valid value variable vector version view visible web width window word worker wrapper write zone".split()
HEX_WORDS = "dead beef cafe babe face feed fade deaf added facade decade bead ace bad add dad fed bed cab dab fee bee ad be".split()

_SPANS = "array<struct<b:int,e:int>>"


def _spans(text: Column, pattern: str, keep=None, group: int = 0) -> Column:
    """Code-point spans of leftmost non-overlapping matches; keep judges a match by its group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    picked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.zip_with(F.arrays_zip(gaps.alias("g"), F.transform(found, lambda m: F.length(m)).alias("n")), picked, lambda p, m: F.struct(p["g"].alias("g"), p["n"].alias("n"), m.alias("m")))
    parts = F.filter(parts, lambda p: p["n"].isNotNull())

    def walked(items: Column) -> Column:
        return _walked(
            items,
            F.lit(0),
            lambda at, p: at + p["g"] + p["n"],
            lambda at, p: F.struct((at + p["g"]).alias("b"), (at + p["g"] + p["n"]).alias("e"), p["m"].alias("m")),
            "struct<b:int,e:int,m:string>",
        )

    spans = _let(parts, walked)
    return F.filter(spans, keep) if keep is not None else spans


def _only(has: Column, spans: Column) -> Column:
    return F.when(has, F.transform(spans, lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e")))).otherwise(F.array().cast(_SPANS))


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """rows with columns assign, access, hex (spans) and tokens (spans with the token as m)."""
    t = F.col(text)
    return rows.withColumns(
        {
            "assign": _only(t.rlike(ASSIGN_WORDS), _spans(t, ASSIGN, lambda s: F.length(s["m"]) >= 8, 2)),
            "access": _only(t.contains("AKIA"), _spans(t, ACCESS)),
            "hex": _only(t.rlike(HEX), _spans(t, HEX)),
            "tokens": F.when(t.rlike(TOKEN), _spans(t, TOKEN)).otherwise(F.array().cast("array<struct<b:int,e:int,m:string>>")),
        }
    )


_HEX, _B32, _B36, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def encoding(token: Column) -> Column:
    """hex, base32, base36, base64 or null."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(mixed & (token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$")), "hex")
        .when(mixed & token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(mixed & (token.rlike("^[0-9a-z]+$") | token.rlike("^[0-9A-Z]+$")), "base36")
        .when(token.rlike("^[A-Za-z0-9+/_-]+={0,2}$") & (mixed | (token.rlike("[a-z]") & token.rlike("[A-Z]"))), "base64")
    )


def _pairs(v: Column) -> Column:
    return F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


ENCODINGS = {"hex": _HEX, "base32": _B32, "base36": _B36, "base64": _B64}


def _joined_words(rng: random.Random, code: str, n: int) -> str:
    """An ordinary identifier in the encoding's symbols, n of them or more."""
    out = ""
    style = rng.randrange(5)
    while len(out) < n:
        word = rng.choice(HEX_WORDS if code == "hex" else WORDS)
        number = str(rng.choice((rng.randrange(10), rng.randrange(100), rng.randrange(1990, 2030), rng.randrange(10**6), 0, 1, 2)))
        if code == "hex":
            out += rng.choice((word, number, number.zfill(rng.randrange(2, 9)), rng.choice("0123456789abcdef") * rng.randrange(2, 8)))
        elif code == "base64":
            part = (word, word.capitalize(), word.upper(), word.capitalize() if out else word, rng.choice((word, word.capitalize(), word.upper())))[style]
            out += part + (number if rng.random() < 0.25 else "") + rng.choice(("-_/-" if style in (0, 2) else "/" if style == 4 else " "))
            out = out.replace(" ", "")
        else:
            out += word.upper() if code == "base32" else word
            out += number if rng.random() < 0.35 else ""
            if code == "base32":
                out = out.translate({ord(a): b for a, b in zip("0189", "2345", strict=True)})
    return out.translate({ord("-"): "+", ord("_"): "/"})


TESTS = ("chi", "runs", "serial", "classes")


def _classes(alphabet: str) -> str:
    """The class of each symbol, as digits."""
    return "".join("0" if c.isdigit() else "1" if c.islower() else "2" if c.isupper() else "3" for c in alphabet)


def _change(alphabet: str) -> float:
    """Chance that two random symbols differ in class."""
    classes = _classes(alphabet)
    return 1 - sum((classes.count(c) / len(classes)) ** 2 for c in set(classes))


def deviates(values: np.ndarray, alphabet: str) -> np.ndarray:
    """The battery's deviates of rows of symbol numbers; 99 where a test can't be made."""
    k, classes, p = len(alphabet), np.array([int(c) for c in _classes(alphabet)])[values], _change(alphabet)
    values = values.astype(float)
    m, n = values.shape
    squares = sum(((values == v).sum(axis=1) ** 2.0 for v in range(k)), np.zeros(m))
    spread = 2 / (9 * (k - 1))
    chi = (np.cbrt(np.maximum(squares * k / n - n, 0) / (k - 1)) - (1 - spread)) / math.sqrt(spread)
    high = values >= k / 2
    n1 = high.sum(axis=1).astype(float)
    mean = n1 * (n - n1) * 2 / n + 1
    sd = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    runs = np.where((n1 == 0) | (n1 == n), 99.0, ((high[:, 1:] != high[:, :-1]).sum(axis=1) + 1 - mean) / sd)
    apart = values - values.mean(axis=1, keepdims=True)
    size = (apart * apart).sum(axis=1)
    serial = np.where(size == 0, 99.0, ((apart[:, 1:] * apart[:, :-1]).sum(axis=1) / np.where(size == 0, 1, size) + 1 / n) * math.sqrt(n))
    changes = (classes[:, 1:] != classes[:, :-1]).sum(axis=1)
    return np.stack((chi, runs, serial, (changes - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p))), axis=1)


LIMIT = 12.0


@cache
def discriminants(seed: int = 3) -> dict[tuple[str, int], tuple[float, ...]]:
    """For each encoding and length: weights of the deviates, and a constant."""
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    out = {}
    for code, alphabet in ENCODINGS.items():
        number = np.zeros(128, np.int64)
        number[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
        long = [number[np.frombuffer(_joined_words(rng, code, NODES[-1] + 32).encode(), np.uint8)] for _ in range(SIMULATED)]
        for n in NODES:
            ordinary = np.array([x[at : at + n] for x in long for at in [rng.randrange(len(x) - n + 1)]])
            x = np.clip(deviates(ordinary, alphabet), -LIMIT, LIMIT)
            y = np.clip(deviates(draw.integers(0, len(alphabet), (SIMULATED, n)), alphabet), -LIMIT, LIMIT)
            w = np.linalg.solve(np.cov(x.T) + np.cov(y.T), y.mean(axis=0) - x.mean(axis=0))
            score = np.sort(x @ w)
            middle = float(np.median(score))
            # scaled so that the ordinary tokens' upper tail is a normal one's, or lighter
            scale = max(float((score[int(q * SIMULATED)] - middle) / z) for q, z in ((0.9, 1.2816), (0.99, 2.3263), (0.999, 3.0902)))
            out[code, n] = (*(float(v) for v in w / scale), -middle / scale)
    return out


def _combined(code: Column, n: Column, parts: list[Column]) -> Column:
    """The combined deviate, by the weights of the encoding at the next lower length of NODES."""
    found = discriminants()
    rows = F.array(*[F.array(*[F.lit(v) for v in found[c, m]]) for c in ENCODINGS for m in NODES])
    node = reduce(lambda c, i: F.when(n >= NODES[i], i).otherwise(c), range(1, len(NODES)), F.lit(0))
    which = F.array_position(F.array(*map(F.lit, ENCODINGS)), code).cast("int") - 1
    clipped = [F.least(F.greatest(p, F.lit(-LIMIT)), F.lit(LIMIT)) for p in parts]
    return _let(F.element_at(rows, which * len(NODES) + node + 1), lambda w: sum((F.element_at(w, i + 1) * p for i, p in enumerate(clipped)), F.element_at(w, len(TESTS) + 1)))


def _tests(x: Column) -> Column:
    """Deviates from struct(code, values, n, k, mean)."""
    n, k, values = x["n"], x["k"], x["values"]
    squares = _sum(F.transform(F.array_distinct(values), lambda v: F.pow(F.size(F.filter(values, lambda w: w == v)).cast("double"), F.lit(2.0))))
    spread = F.lit(2.0) / (F.lit(9.0) * (k - 1))
    chi = (F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)

    def runs(high: Column) -> Column:
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        found = F.size(F.filter(_pairs(high), lambda p: p["a"] != p["b"])) + F.lit(1.0)
        mean = n1 * (n - n1) * 2 / n + 1
        sd = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        return F.when((n1 == 0) | (n1 == n), F.lit(99.0)).otherwise((found - mean) / sd)

    apart = F.transform(values, lambda v: v - x["mean"])
    serial = _let(
        F.struct(_sum(F.transform(apart, lambda d: d * d)).alias("v"), _sum(F.transform(_pairs(apart), lambda p: p["a"] * p["b"])).alias("p")),
        lambda y: F.when(y["v"] == 0, F.lit(99.0)).otherwise((y["p"] / F.nullif(y["v"], F.lit(0.0)) + F.lit(1.0) / n) * F.sqrt(n)),
    )
    names = list(ENCODINGS)
    pick = lambda f: reduce(lambda c, name: F.when(x["code"] == name, F.lit(f(ENCODINGS[name]))).otherwise(c), names[:-1], F.lit(f(ENCODINGS[names[-1]])))
    change = pick(_change)
    classes = F.transform(values, lambda v: F.substring(pick(_classes), v.cast("int") + 1, F.lit(1)))
    changes = F.size(F.filter(_pairs(classes), lambda p: p["a"] != p["b"])).cast("double")
    by_class = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (F.lit(1.0) - change))
    tests = F.struct(chi.alias("chi"), _let(F.transform(values, lambda v: v >= k / 2), runs).alias("runs"), serial.alias("serial"), by_class.alias("classes"))
    return _let(tests, lambda t: F.struct(x["code"].alias("code"), n.cast("int").alias("n"), *[t[c].alias(c) for c in TESTS], _combined(x["code"], n, [t[c] for c in TESTS]).alias("combined")))


def battery(token: Column) -> Column:
    """struct(code, n, chi, runs, serial, classes, combined): deviates of a token, null if it has no encoding."""

    def coded(code: Column) -> Column:
        bare = F.regexp_replace(token, "=+$", "")
        body = F.when(code.isin("hex", "base36"), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
        alphabet = reduce(lambda c, name: F.when(code == name, ENCODINGS[name]).otherwise(c), ("hex", "base32", "base36"), F.lit(_B64))
        return _let(F.struct(code.alias("code"), body.alias("body"), alphabet.alias("alphabet")), valued)

    def valued(x: Column) -> Column:
        values = F.transform(F.filter(F.split(x["body"], ""), lambda c: c != ""), lambda c: F.call_function("locate", c, x["alphabet"]).cast("double") - 1)
        return _let(F.struct(x["code"].alias("code"), values.alias("values"), F.length(x["body"]).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k")), centred)

    def centred(x: Column) -> Column:
        return _let(F.struct(*[x[c].alias(c) for c in ("code", "values", "n", "k")], (_sum(x["values"]) / x["n"]).alias("mean")), _tests)

    return _let(encoding(token), lambda code: F.when(code.isNotNull() & (F.length(F.regexp_replace(token, "=+$", "")) >= LENGTHS[0]), coded(code)))


def _deviate(p: float) -> float:
    """z with an upper tail of p, by bisection."""
    low, high = -40.0, 40.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) / 2 > p else (low, mid)
    return low


def maybe_random(b: Column) -> Column:
    """chi-squared is one-sided: a token may be more even than chance makes it."""
    one, two = _deviate(ALPHA / 4), _deviate(ALPHA / 8)
    return (b["chi"] <= one) & (F.abs(b["runs"]) <= two) & (F.abs(b["serial"]) <= two) & (F.abs(b["classes"]) <= two)


def _length_class(n: Column) -> Column:
    return reduce(lambda c, i: F.when(n >= LENGTHS[i], i).otherwise(c), range(1, len(LENGTHS)), F.lit(0))


def _bin(z: Column) -> Column:
    return F.least(F.greatest(F.floor(z / BIN), F.lit(-TOP_BIN)), F.lit(TOP_BIN)).cast("int")


def limits(tokens: DataFrame) -> list[int | None]:
    """For each class of lengths the lowest bin of deviates that the Benjamini-Hochberg step accepts. tokens: (b) of battery()."""
    counted = tokens.groupBy(_length_class(F.col("b.n")).alias("c"), _bin(F.col("b.combined")).alias("z")).agg(F.count("*").alias("n"))
    rows = counted.collect()  # classes times bins at most
    out: list[int | None] = []
    for c in range(len(LENGTHS)):
        bins = sorted(((r.z, r.n) for r in rows if r.c == c), reverse=True)
        total, seen, best = sum(n for _, n in bins), 0, None
        for z, n in bins:
            seen += n
            if math.erfc(z * BIN / math.sqrt(2)) / 2 * total / seen <= FDR:
                best = z
        out.append(best)
    return out


def corpus_limits(docs: DataFrame, text_col: str = "text") -> list[int | None]:
    t = F.col("t")
    texts = docs.select(F.col(text_col).alias("t")).where(t.rlike(TOKEN))
    tokens = texts.select(F.explode(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).alias("m"))
    return limits(tokens.select(battery(F.col("m")).alias("b")).where("b is not null"))


def with_findings(rows: DataFrame, limit: list[int | None]) -> DataFrame:
    """Adds random (spans) to rows of with_base()."""

    def passes(b: Column) -> Column:
        floor = reduce(lambda c, i: F.when(_length_class(b["n"]) == i, F.lit(TOP_BIN + 1 if limit[i] is None else limit[i])).otherwise(c), range(1, len(LENGTHS)), F.lit(TOP_BIN + 1 if limit[0] is None else limit[0]))
        return F.coalesce(maybe_random(b) & (_bin(b["combined"]) >= floor), F.lit(False))

    # known spans and tokens in order: a token lies in a known span if the ends so far reach its own
    tagged = lambda c, token: F.transform(c, lambda s: F.struct(s["b"].alias("b"), F.lit(token).alias("token"), s["e"].alias("e"), (s["m"] if token else F.lit("")).alias("m")))
    both = F.array_sort(F.concat(tagged("assign", 0), tagged("access", 0), tagged("hex", 0), tagged("tokens", 1)))
    marked = _let(
        both,
        lambda items: _walked(
            items,
            F.lit(0),
            lambda reach, s: F.when(s["token"] == 1, reach).otherwise(F.greatest(reach, s["e"])),
            lambda reach, s: F.struct(s["b"].alias("b"), s["e"].alias("e"), s["m"].alias("m"), ((s["token"] == 1) & (reach < s["e"])).alias("open")),
            "struct<b:int,e:int,m:string,open:boolean>",
        ),
    )
    found = F.filter(marked, lambda s: s["open"] & passes(battery(s["m"])))
    return rows.withColumn("random", F.when(F.size("tokens") > 0, F.transform(found, lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e")))).otherwise(F.array().cast(_SPANS)))


def _joined(*kinds: str) -> Column:
    def placed(i: int):
        return lambda s: F.struct(s["b"].alias("b"), F.lit(i).alias("i"), s["e"].alias("e"))

    parts = [F.transform(F.col(k), placed(i)) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", F.element_at(names, s["i"] + 1), s["b"], s["e"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    based = stored(with_base(texts, "t").drop("t"))
    tokens = based.where(F.size("tokens") > 0).select(F.explode("tokens").alias("s")).select(battery(F.col("s.m")).alias("b")).where("b is not null")
    found = with_findings(based, limits(tokens))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(*KINDS[:3]), 256).alias("base_sha256"), _joined(*KINDS).alias("spans"))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans (sorted) replaced by the mark.

    A place in a text is found by reading up to it, so the text before and
    between spans is cut out of the stretch that a block of spans covers.
    """
    block = lambda i: F.slice(spans, i * common.STEP + 1, F.lit(common.STEP))
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / common.STEP).cast("int"))
    reach = lambda items, at: F.aggregate(items, at, lambda r, s: F.greatest(r, s["e"]))
    begun = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, i: F.struct(reach(block(i), acc["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def pieces(at: Column, i: Column) -> Column:
        stretch = F.substring(text, at + 1, F.greatest(F.element_at(block(i), -1)["b"] - at, F.lit(0)))
        return _let(stretch, lambda part: within(part, at, i))

    def within(part: Column, first: Column, i: Column) -> Column:
        return F.aggregate(
            block(i),
            F.struct(first.alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["e"]).alias("at"),
                F.when(s["b"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(part, acc["at"] - first + 1, s["b"] - acc["at"]), F.lit(mark))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    last = reach(spans, F.lit(0))
    return F.concat(F.array_join(F.transform(begun, pieces), ""), F.substring(text, last + 1, F.length(text)))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """The documents with every span, or run of overlapping spans, of their text replaced by the mark.

    length_col: a column that holds the text's length in characters and follows it where it changes.
    """
    limit = corpus_limits(docs, text_col)
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = with_findings(with_base(rows, "t"), limit)
    spans = F.array_sort(F.concat(*KINDS))
    text = F.when(F.size(spans) == 0, F.col(f"row.{text_col}")).otherwise(_let(spans, lambda s: _marked(F.col("t"), s, mark)))
    done = found.withColumn("done", text)
    kept = {c: F.col(f"row.`{c}`") for c in columns} | {text_col: F.col("done")}
    if length_col in kept:
        kind = docs.schema[length_col].dataType
        kept[length_col] = F.when(F.size(spans) == 0, kept[length_col]).otherwise(F.length("done").cast(kind))
    return done.select(*[kept[c].alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
