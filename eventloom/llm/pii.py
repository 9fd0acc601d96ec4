"""Personal data by candidate gradient boosting (DataFrame functions only).

Base patterns find e-mail and IP addresses, card and phone numbers; their
matches always count. High-recall generators propose further, overlapping
spans of the same kinds (spelled-out addresses, hosts without a domain, IPv6,
cards of other lengths, phone numbers without a country code). Boosted trees
over format and context features score each proposal, and per-kind thresholds
on calibrated probabilities select what is added. Selected proposals that
overlap a base span, or one selected before them, are left out. A fifth kind,
secrets (keys, tokens, passwords), has proposals only.

The trees are trained here, on labelled sentences made by rule
(``TRAINING_ROWS`` of them, a bounded sample); they become a SQL expression, so
that scoring is part of the row's own projection: no shuffle, no Python on the
executors. The words that lead to a span in these sentences are only in part
those that the features know, and the sentences that calibrate the scores and
set the thresholds have other leading words than those trained on.

Defined results: a null text counts as empty; texts without matches have empty
span lists, and texts of any length are searched whole; each row is handled on
its own, so repeated rows agree, and an empty table gives one. Further columns
stay, whatever their names: those that are added take free names. Places are
code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import free_names, read

#: The kinds with base patterns, and all.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
TRAINING_ROWS = 5000
SEED = 5
ROUNDS, DEPTH, RATE = 40, 3, 0.3
#: Precision that the threshold of each kind must reach on held-out rows.
PRECISION = 0.97
CONTEXT = 24

#: The base patterns, with the possessive forms and starts that keep matching linear: a match can only start where its first run starts, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: (kind, pattern): what proposes.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)*+"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+::?+){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])"),
    ("phone", r"(?<![0-9])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,5}+\)?)++(?![0-9])"),
    ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+"),
)
#: What a generator needs to match at all.
NEEDS = (r"@|(?i:at)", r":", r"[0-9]", r"[0-9]", r"[0-9]")
GOOD_WORDS = ("mail|contact|write|reach|address", "ip|host|server|addr|client|peer", "card|visa|credit|pay|amex|debit|master", "tel|phone|call|fax|mobile|dial|cell|ring", "token|secret|passw|key|auth|bearer|credential")
BAD_WORDS = r"version|order|invoice|isbn|ref|build|page|date|serial|item|ticket|total|count|score|time|meet|look|arrive|room|year"
FEATURES = ("kind", "digits", "letters", "gaps", "luhn", "length", "good", "bad", "before", "after", "dated", "domain", "distinct", "at", "turns")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; the last digit counts as it is, every second before it doubled."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<s: int, e: int, m: string>>`` of the leftmost non-overlapping matches.

    The stretches between matches and the matches themselves alternate, so
    places are running sums of lengths.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.array().cast("array<struct<s: int, e: int, m: string>>")

    def step(a: Column, p: Column) -> Column:
        s = a["at"] + F.length(p["gap"])
        e = s + F.length(p["m"])
        return F.struct(F.coalesce(e, s).alias("at"), F.when(p["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m"))))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def _base_spans(text: Column, kind: str) -> Column:
    found = matches(text, BASE[kind])
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.filter(found, lambda x: F.forall(F.split(x["m"], r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255)))
    if kind == "card":
        return F.filter(found, lambda x: F.length(_digits(x["m"])).between(16, 19) & luhn(_digits(x["m"])))
    if kind == "phone":
        return F.filter(found, lambda x: F.length(_digits(x["m"])).between(8, 15))
    return found


def _features(text: Column, x: Column, kind: int) -> list[Column]:
    m, digits = x["m"], _digits(x["m"])
    start = F.greatest(F.lit(1), x["s"] - CONTEXT + 1)
    before = F.lower(F.substring(text, start, x["s"] - start + 1))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    last = F.right(before, F.lit(1))
    glued = lambda c: F.when(c.rlike(r"[\p{L}0-9]"), 2).when(c.rlike(r"[=/#_.:-]"), 1).otherwise(0)
    return [
        F.lit(kind),
        F.length(digits),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(m, r"[^\x20./()-]", "")),
        F.when(luhn(digits) & (digits != ""), 1).otherwise(0),
        F.length(m),
        F.when(before.rlike(rf"\b(?:{GOOD_WORDS[kind]})"), 1).otherwise(0),
        F.when(before.rlike(rf"\b(?:{BAD_WORDS})"), 1).otherwise(0),
        glued(last),
        glued(after),
        F.when(m.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[ /-]{1,2}(?:19|20)?[0-9]{2})"), 1).otherwise(0),
        F.when(m.rlike(r"(?i)(?:\.|dot[)\]]?\x20?)(?:com|org|net|edu|gov|info|io|eu|[a-z]{2})$"), 1).otherwise(0),
        F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda c: c != ""))),
        F.when(m.contains("@"), 2).when(m.rlike(r"(?i)[(\[]at[)\]]"), 1).otherwise(0),
        F.least(F.lit(50), F.regexp_count(m, F.lit("[A-Za-z][0-9]"))),
    ]


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a ``_base_<kind>`` list of spans for each kind and ``_proposed``, all proposals with their features."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<s: int, e: int, m: string>>")
    needs = {"email": t.contains("@"), "phone": t.contains("+")}
    out = docs.withColumns({f"_base_{k}": F.when(needs.get(k, t.rlike("[0-9]")), _base_spans(t, k)).otherwise(none) for k in KINDS})
    out = out.withColumns({f"_gen_{i}": F.when(t.rlike(NEEDS[i]), matches(t, p)).otherwise(none) for i, (_, p) in enumerate(GENERATORS)})

    def proposal(kind: int):  # a default argument would make the lambda one of two arguments
        return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*[f.cast("int") for f in _features(t, x, kind)]).alias("f"))

    proposed = [F.transform(f"_gen_{i}", proposal(ALL_KINDS.index(k))) for i, (k, _) in enumerate(GENERATORS)]
    return out.withColumn("_proposed", F.concat(*proposed)).drop(*[f"_gen_{i}" for i in range(len(GENERATORS))])


#: What leads to a span in sentences: (trained on, calibrated on) for each kind, and for what isn't personal.
LEADS = (
    ("mail|contact|write to|reach me under|schreiben Sie an|courriel|say hello to", "address|my inbox|escriba a|an|ask"),
    ("host|server|from|node|Rechner|l'adresse|connected to", "peer|client|via|equipo|blocked"),
    ("card|visa|paid with|Kartennummer|tarjeta|number", "debit|Kreditkarte|la carte|charge|on file"),
    ("tel|call|mobile|Rufnummer|au|llame al|line", "phone|fax|ring|Telefon|by wire"),
    ("token|secret|password|Passwort|clave|value", "api key|auth|bearer|mot de passe|login with"),
)
PLAIN_LEADS = ("version|order|invoice|page|date|build|ticket|am|um|Seite|total|in", "isbn|ref|serial|score|room|year|Raum|Kapitel|vers|count|until|item")


def training_text(rng: random.Random, held: bool) -> tuple[str, int, int, int]:
    """A sentence made by rule, the place of what it holds, and whether that is personal; with other leading words if ``held``."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = lambda n: " ".join(word() for _ in range(n))

    def card(n: int, good: bool) -> str:
        body = [int(c) for c in digits(n - 1)]
        total = sum(d if i % 2 else (2 * d) % 10 + 2 * d // 10 for i, d in enumerate(reversed(body)))
        return "".join(map(str, body)) + str((-total + (0 if good else rng.randint(1, 9))) % 10)

    kind, good = rng.randrange(5), rng.random() < 0.5
    own, plain = LEADS[kind][held].split("|"), PLAIN_LEADS[held].split("|")
    lead = rng.choice(own) if good and rng.random() < 0.6 else rng.choice(plain) if not good and rng.random() < 0.6 else word()
    if kind == 0:
        domain = rng.choice([".com", ".org", ".net", ".de", ".fr", ".info"])
        if good:
            at, dot = rng.choice([("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), ("(at)", ".")])
            span = word() + rng.choice([".", "", "_"]) + word() + at + word() + (dot + domain[1:] if dot != "." else domain)
        else:
            span = rng.choice([f"{word()} at {word()}", f"{word()}@{word()}", f"{word()} at {word()}", f"{word()} at {word()}-{word()}"])
    elif kind == 1:
        group = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        span = ":".join(group(rng.choice([4, 4, 3])) for _ in range(8)) if good else ":".join(digits(2) for _ in range(rng.choice([3, 3, 4, 6])))
    elif kind == 2:
        n = rng.choice([13, 14, 15, 15, 15, 16]) if good else rng.choice([13, 13, 14, 15, 16, 17, 19])
        body = card(n, good)
        cuts = (4, 10) if n == 15 else (4, 8, 12)
        gap = rng.choice(["", " ", "-", "."] if good else ["", "", "."])
        span = gap.join(body[a:b] for a, b in zip((0, *cuts), (*cuts, n), strict=True))
    elif kind == 4:
        random_of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
        if good:
            hexes = rng.choice(["0123456789abcdef", "0123456789ABCDEF"])
            every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
            span = rng.choice([random_of(hexes, rng.choice([32, 40, 64])), random_of(every, rng.randint(20, 48)), f"{word()[:2]}_{random_of(every, rng.randint(24, 40))}"])
            if not re.search("[0-9]", span):
                span += "7"
        else:
            span = rng.choice([f"{word()}-{word()}-{word()}-{digits(2)}", f"/{word()}/{word()}/{word()}{digits(1)}/{word()}", digits(rng.randint(16, 30)), f"{word()}_{word()}_{word()}{digits(3)}", f"20{digits(2)}-{word()}-{word()}-{word()}"])
            span += "x" * max(0, 16 - len(span)) if not span.isdigit() else ""
    elif good:
        span = rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{digits(3)}/{digits(3)} {digits(3)}", f"({digits(4)}) {digits(3)}-{digits(3)}"])
    else:
        span = rng.choice([f"20{digits(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.choice(['19', '20'])}{digits(2)}", f"{digits(2)} {digits(2)}", f"{digits(3)}.{digits(2)}", f"{digits(2)}/{digits(3)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(2)}", f"{digits(2)} - {digits(2)}", f"19{digits(2)}-19{digits(2)}"])
    start = words(rng.randint(1, 4)) + " " + lead + (rng.choice([": ", " ", " ", " is "]) if kind < 4 else rng.choice([": ", " ", ' = "', "=", " is "]))
    return start + span + rng.choice([" ", ". ", ", ", ""] if not start.endswith('"') else ['" ', '"']) + words(rng.randint(0, 3)), len(start), len(start) + len(span), int(good)


@dataclass
class Model:
    """Boosted trees, the calibration, and the thresholds on calibrated scores."""

    trees: list
    first: float
    scale: float
    shift: float
    thresholds: list[float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.first + sum(_apply(t, x) for t in self.trees)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margins(x) + self.shift)))

    def column(self, features: Column) -> Column:
        def tree(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(features[t[0]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

        total = F.lit(self.first)
        for t in self.trees:
            total = total + tree(t)
        return 1 / (1 + F.exp(-(total * self.scale + self.shift)))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), tree) if not isinstance(tree, tuple) else np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    leaf = float(RATE * g.sum() / (h.sum() + 1.0))
    best, cut = 1e-6, None
    score = lambda a, b: a * a / (b + 1.0)
    whole = score(g.sum(), h.sum())
    for f in range(x.shape[1]) if depth else ():
        for v in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= v
            if min(h[low].sum(), h[~low].sum()) < 1.0:
                continue
            gain = score(g[low].sum(), h[low].sum()) + score(g[~low].sum(), h[~low].sum()) - whole
            if gain > best:
                best, cut = gain, (f, int(v))
    if cut is None:
        return leaf
    low = x[:, cut[0]] <= cut[1]
    return (*cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Model:
    """Trees on (x, y); the calibration and the thresholds on the held-out rows."""
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    model = Model([], float(np.log(rate / (1 - rate))), 1.0, 0.0, [])
    margin = np.full(len(y), model.first)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        model.trees.append(_grow(x, y - p, p * (1 - p), DEPTH))
        margin += _apply(model.trees[-1], x)
    m, a, b = model.margins(held_x), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * m + b)))
        a, b = a + 0.05 * float(((held_y - p) * m).mean()), b + 0.05 * float((held_y - p).mean())
    model.scale, model.shift = a, b
    for k in range(len(ALL_KINDS)):
        own = held_x[:, 0] == k
        p, y_own = model.probabilities(held_x[own]), held_y[own]
        good = [t for t in np.unique(np.round(p, 3)) if t >= 0.5 and (p >= t).any() and y_own[p >= t].mean() >= PRECISION]
        model.thresholds.append(float(min(good, default=2.0)))
    return model


def train(spark: SparkSession) -> Model:
    """The model, from ``TRAINING_ROWS`` sentences made by rule; every third is held out. A proposal is right when it lies on a personal span and covers most of it."""
    rng = random.Random(SEED)
    rows = [(i, *training_text(rng, i % 3 == 0)) for i in range(TRAINING_ROWS)]
    made = spark.createDataFrame(rows, "i int, text string, s0 int, e0 int, good int").repartition(4)
    got = with_candidates(made, "text").select("i", "s0", "e0", "good", F.explode("_proposed").alias("p")).select("i", "s0", "e0", "good", "p.*").orderBy("i", "k", "s").collect()
    x = np.array([r.f for r in got])
    y = np.array([float(r.good and r.s0 - 1 <= r.s and r.e <= r.e0 + 1 and 10 * (r.e - r.s) >= 9 * (r.e0 - r.s0)) for r in got])
    held = np.array([r.i % 3 == 0 for r in got])
    return boost(x[~held], y[~held], x[held], y[held])


def find(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """``docs`` with ``_base_<kind>`` for each of ``KINDS`` and ``_spans`` as the last columns, under free names.

    ``_spans`` is ``array<struct<k: int, s: int, e: int>>`` of all spans by
    kind (of ``ALL_KINDS``) and start.
    """
    names = free_names(docs, *[f"_base_{k}" for k in KINDS], "_spans")
    out = with_candidates(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text")

    def placed(kind: int):
        return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"))

    every = F.concat(*[F.transform(f"_base_{k}", placed(i)) for i, k in enumerate(KINDS)])
    out = out.withColumn("_sure", every)
    least = F.array(*[F.lit(t) for t in model.thresholds])
    chosen = F.filter("_proposed", lambda p: (model.column(p["f"]) >= F.element_at(least, p["k"] + 1)) & ~F.exists("_sure", lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"])))
    lined = F.array_sort(F.transform(chosen, lambda p: F.struct(p["s"], p["e"], p["k"])))
    kept = F.aggregate(
        lined,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<k: int, s: int, e: int>>").alias("out")),
        lambda a, p: F.when(p["s"] < a["end"], a).otherwise(F.struct(p["e"].alias("end"), F.concat(a["out"], F.array(F.struct(p["k"].alias("k"), p["s"].alias("s"), p["e"].alias("e")))).alias("out"))),
        lambda a: a["out"],
    )
    made = [F.col(f"_base_{k}") for k in KINDS] + [F.col("_spans")]
    # In a step of its own, before the caller's names come back.
    out = out.select("row", *[f"_base_{k}" for k in KINDS], F.array_sort(F.concat("_sure", kept)).alias("_spans"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[c.alias(n) for c, n in zip(made, names, strict=True)])


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    lined = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["e"], x["k"])))
    step = lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.element_at(names, x["k"] + 1)).alias("out"))
    )
    return F.aggregate(lined, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; ``spans`` has its four kinds, and ``secrets`` the fifth. ``n_found`` counts all, and ``redacted`` is the text without them."""
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", train(spark))

    def digest(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])

    base = F.concat(*[F.transform(f"_base_{k}", digest(k)) for k in KINDS])
    part = lambda secret: F.filter("_spans", lambda x: (x["k"] == len(KINDS)) if secret else (x["k"] < len(KINDS)))
    return found.select(
        "doc_id",
        *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        _listed(part(False)).alias("spans"),
        _listed(part(True)).alias("secrets"),
        F.size("_spans").cast("long").alias("n_found"),
        redacted(F.coalesce("text", F.lit("")), F.col("_spans")).alias("redacted"),
    )
