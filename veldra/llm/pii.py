"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans follow fixed formats (email, ip, card, phone). High-recall generators propose further, overlapping
candidates: addresses with their signs spelled out or bracketed, and runs of numbers as an ip, a card and a phone: the
longest, those without spaces, and those whose joints are of one character, which take the numbers of a list apart.
What has more digits than any kind is no candidate. Boosted trees score a candidate by its format and its context; a threshold for each kind,
calibrated on held-out candidates, selects what is added to the base spans. The trees are fitted on the driver from a
bounded sample of candidates, with the base formats as labels. Their telling signs are masked (the at sign and how
dots are written, the plus, a card's number of digits is no gate), so that they judge by looks and surroundings what
the formats miss; runs of numbers of other kinds are their negatives, and so are near misses: the candidates of the
right label with their check broken (the check sum, the octets). The trees are then laid out as nested conditions. No
Python runs on executors.

Matching is linear in the text, also in very long runs: a run is entered at its start or where a match has ended, and
its characters are never given back. The one loop over a group is possessive, which runs without recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import hash_sample, materialize, pick, place_of, table

KINDS = ["email", "ip", "card", "phone"]

LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: separators that don't stand between two digits end a card's run
LOOSE = r"[ -](?![0-9])|(?<![0-9])[ -]"
CARD = r"[0-9 -]{2,}+"
CARD_GATE = r"[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: generators of candidates: (kinds, pattern, what a text must hold). Loops over groups are possessive
_AT, _DOT = r" ?+(?:@|\(at\)|\[at\]) ?+| at ", r" ?+(?:\(dot\)|\[dot\]|\.) ?+| dot "
_DOTS = r" ?+(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?+| \. | dot "
_NUMBERS = rf"\(?+[0-9]++(?:(?:{_DOTS}|[ .,:/()-]{{1,3}}+)[0-9]++)*+"
_TIGHT = r"[0-9]++(?:[.,:/()-]{1,2}+[0-9]++)*+"
#: joints that one number has: numbers of a list, behind commas or wider gaps, are runs of their own
_LISTED = r"\(?+[0-9]++(?:(?:\)[ -]?+|[ .:/-])[0-9]++)*+"
GENERATORS = [
    (["email"], rf"(?<![{LOCAL}@])[{LOCAL}]++(?:{_AT})[{HOST}]++(?:(?:{_DOT})[{HOST}]++)++", ["@", "(at)", "[at]"], (" at ", rf" at [{HOST}]++(?:{_DOT})[{HOST}]")),
    (["ip", "card", "phone"], _NUMBERS, [], ("", "[0-9]")),
    (["ip", "card", "phone"], _TIGHT, [], ("", "[0-9]")),
    (["ip", "card", "phone"], _LISTED, [], ("", "[0-9]")),
]


def gated(text: Column, signs: list[str], other: tuple[str, str]) -> Column:
    """Whether a text can hold a candidate: it has one of the signs, or a sign and then a pattern."""
    out = F.when(text.contains(other[0]), text.rlike(other[1])).otherwise(F.lit(False))
    for sign in signs:
        out = text.contains(sign) | out
    return out


#: how many digits a candidate of a kind may have
DIGITS = {"ip": (4, 16), "card": (8, 20), "phone": (7, 16)}

SPAN = "array<struct<s:int,e:int,m:string>>"
CONTEXT = 24


def _none() -> Column:
    return F.array().cast(SPAN)


def located(text: Column, pattern: str, gate: Column) -> Column:
    """Matches with their places in code points, end exclusive. What lies between the matches gives the places."""
    ms = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(ms)), ms, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(gate, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(_none())


def _of_kind(kind: int, *fields: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), *[x[f].alias(f) for f in fields])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of card numbers; false for an empty string."""
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        two = d * 2
        return acc + F.when(i % 2 == 0, F.when(two > 9, two - 9).otherwise(two)).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255
    )


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, in order of their start. text must not be null."""
    cards = F.regexp_replace(text, LOOSE, "x")
    card = located(cards, CARD, text.rlike(CARD_GATE))
    return {
        "email": located(text, EMAIL, text.contains("@")),
        "ip": F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: _octets(x["m"])),
        "card": F.filter(F.filter(card, lambda x: _between(F.char_length(digits_of(x["m"])), 16, 19)), lambda x: luhn(digits_of(x["m"]))),
        "phone": F.filter(located(text, PHONE, text.contains("+")), lambda x: _between(F.char_length(digits_of(x["m"])), 8, 15)),
    }


# ---- candidates and their features

FEATURES = [
    "digits", "length", "spaces", "dashes", "brackets", "groups", "longest_group", "shortest_group", "letters", "capitals", "dots",
    "before_word", "before_digit", "after_word", "after_digit", "before_sign", "line_start", "hint", "luhn", "octets",
]
#: the check that a near miss of a kind fails
CHECKS = {"card": "luhn", "ip": "octets"}
HINTS = {
    "email": "mail|contact|write|reach|address",
    "ip": "ip|host|server|addr|login|from",
    "card": "card|visa|account|pay|credit|iban",
    "phone": "phone|tel|call|fax|mobile|cell|contact",
}


def candidate_rows(text: Column) -> Column:
    """All candidates, each once: array of (kind, s, e, m)."""
    out = []
    for kinds, pattern, *gate in GENERATORS:
        found = located(text, pattern, gated(text, *gate))
        if kinds == ["email"]:
            out.append(F.transform(found, _of_kind(KINDS.index("email"), "s", "e", "m")))
            continue
        of = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(DIGITS[k][0]).alias("low"), F.lit(DIGITS[k][1]).alias("high")) for k in kinds])
        sized = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.char_length(digits_of(x["m"])).alias("n")))
        short = F.filter(sized, lambda x: _between(x["n"], min(v for v, _ in DIGITS.values()), max(v for _, v in DIGITS.values())))
        each = lambda x: F.transform(F.filter(of, lambda k: (k["low"] <= x["n"]) & (x["n"] <= k["high"])), lambda k: F.struct(k["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))  # noqa: E731, B023
        out.append(F.flatten(F.transform(short, each)))
    return F.array_distinct(F.concat(*out))


def features(text: Column, x: Column) -> list[Column]:
    """Numbers that describe a candidate, in the order of FEATURES. Dots and at signs count however they are written;
    of an ip, signs other than dots don't."""
    d = digits_of(x["m"])
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["m"], r"^\(", ""), _AT, "@"), rf"{_DOTS}|(?<=[A-Za-z0-9])\. ?+(?=[A-Za-z0-9])", ".")
    groups = F.filter(F.split(core, "[^0-9A-Za-z]+"), lambda g: g != "")
    count = lambda keep: F.char_length(F.regexp_replace(core, keep, ""))
    before = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    last = F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(F.lit(""))
    nxt = F.substring(text, x["e"] + 1, F.lit(1))
    hint = F.lit(False)
    for k, words in HINTS.items():
        hint = hint | ((x["kind"] == KINDS.index(k)) & F.lower(before).rlike(words))
    octet = lambda g: F.coalesce(g.try_cast("int"), F.lit(999)) <= 255
    cols = [
        F.char_length(d), F.char_length(core), count("[^ ]"), count("[^-]"), count(r"[^()\[\]]"), F.size(groups),
        F.array_max(F.transform(groups, F.char_length)), F.array_min(F.transform(groups, F.char_length)), count("[^A-Za-z]"), count("[^A-Z]"), count("[^.]"),
        last.rlike("[A-Za-z]"), last.rlike("[0-9]"), nxt.rlike("[A-Za-z]"), nxt.rlike("[0-9]"), last.rlike(r"[#$%&*/_=-]"),
        last.isin("", "\n"), hint, (x["kind"] == KINDS.index("card")) & luhn(F.substring(d, 1, 20)), (x["kind"] == KINDS.index("ip")) & F.forall(groups, octet),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols]


@dataclass
class Boosted:
    """Trees of depth two over FEATURES for one kind, the score from which a candidate is selected, and the precision
    that this has on held-out candidates."""

    bias: float
    trees: list[tuple[int, float, int, float, int, float, tuple[float, float, float, float]]]
    threshold: float
    precision: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, a, g, b, h, c, leaf in self.trees:
            left = x[:, f] <= a
            out += np.where(left, np.where(x[:, g] <= b, leaf[0], leaf[1]), np.where(x[:, h] <= c, leaf[2], leaf[3]))
        return out

    def column(self, x: list[Column]) -> Column:
        out = F.lit(self.bias)
        for f, a, g, b, h, c, leaf in self.trees:
            out = out + F.when(x[f] <= a, F.when(x[g] <= b, leaf[0]).otherwise(leaf[1])).otherwise(F.when(x[h] <= c, leaf[2]).otherwise(leaf[3]))
        return out


def _stump(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, float, float]:
    """The split with the largest gain: feature, value, gain. A feature's splits are its values, or 64 of their quantiles where
    it has more."""
    best = (0, float("inf"), 0.0)
    g, h = grad.sum(), hess.sum()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])[:-1]
        for v in values if len(values) <= 64 else np.unique(np.quantile(values, np.linspace(0, 1, 64), method="lower")):
            left = x[:, f] <= v
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[2] + 1e-9:
                best = (f, float(v), float(gain))
    return best


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 12, rate: float = 0.4, precision: float = 0.95) -> Boosted:
    """Boosts on two thirds of the candidates; the threshold is the lowest score from which on the held-out third
    has the precision. Without candidates of both labels, or if none has it, nothing is selected."""
    never = Boosted(0.0, [], float("inf"))
    if len(x) < 12 or not 0 < y.sum() < len(y):
        return never
    held = np.arange(len(x)) % 3 == 2
    tx, ty = x[~held], y[~held]
    if not 0 < ty.sum() < len(ty):
        return never
    p = ty.mean()
    out = Boosted(float(np.log(p / (1 - p))), [], float("inf"))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-out.raw(tx)))
        grad, hess = ty - q, q * (1 - q)
        f, a, gain = _stump(tx, grad, hess)
        if gain <= 1e-6:
            break
        left = tx[:, f] <= a
        g, b, _ = _stump(tx[left], grad[left], hess[left])
        h, c, _ = _stump(tx[~left], grad[~left], hess[~left])
        parts = [left & (tx[:, g] <= b), left & ~(tx[:, g] <= b), ~left & (tx[:, h] <= c), ~left & ~(tx[:, h] <= c)]
        leaf = tuple(float(rate * grad[i].sum() / (hess[i].sum() + 1)) for i in parts)
        out.trees.append((f, a, g, min(b, 1e18), h, min(c, 1e18), leaf))
    score, label = out.raw(x[held]), y[held]
    for t in np.unique(score):
        if label[score >= t].mean() >= precision and label[score >= t].sum() >= 3:
            out.threshold, out.precision = float(t) - 1e-9, float(label[score >= t].mean())
            break
    return out


def _few(found: Column, n: int) -> Column:
    """At most n candidates of each kind: those of the smallest hashes of their document and place."""
    out = []
    for kind in map(F.lit, range(len(KINDS))):
        mine = F.filter(found, lambda x: x["kind"] == kind)  # noqa: B023
        order = F.array_sort(F.transform(mine, lambda x: F.struct(F.xxhash64("doc_id", x["kind"], x["s"], x["e"]).alias("h"), x.alias("x"))))
        out.append(F.transform(F.slice(order, 1, n), lambda y: y["x"]))
    return F.concat(*out)


def with_near_misses(x: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Behind each candidate of the right label that passes its kind's check, the same with the check broken."""
    if kind not in CHECKS:
        return x, y
    c = FEATURES.index(CHECKS[kind])
    times = 1 + ((y > 0) & (x[:, c] > 0))
    ax, ay = np.repeat(x, times, axis=0), np.repeat(y, times)
    second = np.flatnonzero(np.r_[False, np.repeat(np.arange(len(y)), times)[1:] == np.repeat(np.arange(len(y)), times)[:-1]])
    ax[second, c], ay[second] = 0, 0
    return ax, ay


def train(docs: DataFrame, sample: int = 4000, per_document: int = 200) -> list[Boosted]:
    """A model for each kind, from at most `sample` documents that have a candidate (those of the smallest hashes).

    Of a document, at most `per_document` candidates of each kind count, and of all, 5 * sample of each kind: those of the
    smallest hashes of their places, so that neither frequent contents nor other kinds keep any out.
    """
    text = F.col("text")
    gates = F.lit(False)
    for _, _, *gate in GENERATORS:
        gates = gates | gated(text, *gate)
    ids = hash_sample(docs.where(gates).select("doc_id"), F.col("doc_id"), sample, docs.count(), spare=64)
    some = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    base = F.concat(*[F.transform(v, _of_kind(KINDS.index(k), "s", "e")) for k, v in base_spans(text).items()])
    rows = some.select("doc_id", "text", base.alias("base"), _few(candidate_rows(text), per_document).alias("c")).select("doc_id", "text", "base", F.explode_outer("c").alias("x"))
    x = F.col("x")
    hit = F.exists("base", lambda b: (b["kind"] == x["kind"]) & (b["s"] < x["e"]) & (x["s"] < b["e"]))
    # (outer, as else Spark asks of every document, before the sample is taken, whether it has a candidate)
    got = rows.where("x is not null").select("doc_id", x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), hit.alias("y"), F.array(*features(text, x)).alias("f"))
    got = materialize(got, "candidates")
    out = []
    for k in range(len(KINDS)):
        mine = hash_sample(got.where(F.col("kind") == k), F.struct("doc_id", "s", "e", "kind"), 5 * sample).collect()
        mx = np.array([r["f"] for r in mine], float).reshape(-1, len(FEATURES))
        out.append(fit(*with_near_misses(mx, np.array([r["y"] for r in mine], float), KINDS[k])))
    return out


def _added(text: Column, base: Column, models: list[Boosted]) -> Column:
    """Selected candidates that no base span overlaps, and of those that overlap each other the first."""
    if not any(m.threshold < float("inf") for m in models):
        return F.array().cast("array<struct<kind:int,s:int,e:int>>")

    def chosen(x: Column) -> Column:
        out = F.lit(False)
        for k, m in enumerate(models):
            if m.threshold < float("inf"):
                out = out | ((x["kind"] == k) & (m.column([x["f"][i] for i in range(len(FEATURES))]) >= m.threshold))
        return out

    free = F.filter(candidate_rows(text), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    # each candidate's features are worked out once, and then compared with the trees
    seen = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.array(*features(text, x)).alias("f")))
    bare = F.array_sort(F.transform(F.filter(seen, chosen), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    put = lambda acc, x: F.concat(acc, F.array(F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.aggregate(bare, empty, lambda acc, x: F.when(F.size(acc) == 0, put(acc, x)).otherwise(F.when(F.try_element_at(acc, F.lit(-1))["e"] <= x["s"], put(acc, x)).otherwise(acc)))


def find_spans(docs: DataFrame, *, models: list[Boosted] | None = None, sample: int = 4000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, base and spans: arrays of (kind, s, e) by kind, then start.

    docs has doc_id and text (null: empty). Rows of repeated ids are each searched; an empty table gives none.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    models = train(docs, sample) if models is None else models
    t = F.col("text")
    found = docs.select("doc_id", *keep, "text", *[v.alias(f"_{k}") for k, v in base_spans(t).items()])
    flat = F.concat(*[F.transform(f"_{k}", _of_kind(i, "s", "e")) for i, k in enumerate(KINDS)])
    both = found.select("doc_id", *keep, "text", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], flat.alias("base"))
    return both.withColumn("spans", F.array_sort(F.concat("base", _added(t, F.col("base"), models))))


def _joined(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 (of kind:start:end of the base spans) and spans (all
    of them, so joined).

    Null and empty texts have no spans. Repeated rows and null ids each get their row, equal texts equal values; an
    empty table gives none. Of candidates that overlap each other the one that begins first is added, of those that
    begin together the shorter, of equal ones the kind listed first.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = find_spans(docs, **kw)
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; spans that overlap go as one, under the
    kind of the first. All other columns stay; a null text stays null."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at, key = place_of(docs, text_col), place_of(docs, id_col)
    work = flat.select(F.col(f"_c{key}").alias("doc_id"), F.col(f"_c{at}").alias("text"), F.struct(*flat.columns).alias("_row"))
    found = find_spans(work, keep=("_row",), **kw)
    t, name = F.col("text"), F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("<"), F.element_at(name, x["kind"] + 1), F.lit(">"))))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.char_length(t))))
    clean = F.when(F.col("_row")[f"_c{at}"].isNull(), F.lit(None).cast("string")).when(F.size("spans") == 0, t).otherwise(done)
    return found.select(*[(clean if i == at else F.col("_row")[f"_c{i}"]).alias(n) for i, n in enumerate(names)])


def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))
