"""Operator 5: personal data by weak supervision (native).

Candidates are spans of base patterns (e-mail, IP, card, phone) and of further
patterns (spelled-out e-mail, local phone, social-security number, IBAN,
secret). Five labelers vote on each: strictness of its regex, gazetteers,
context words, shape, and boundary. EM over the counts of vote patterns
estimates their reliabilities; its posteriors train a naive-Bayes classifier
over span features, which decides on every span that is not a base one. Base
spans always stay.

Positions are code points, end exclusive. Defined cases: null text counts as
empty; texts without candidates have no spans (the digest is that of the empty
string); spans of one kind that tie are told apart by their start, of several
kinds by the order of kinds; repeated rows get the same answer each; null doc_id
is carried through; texts of any length are read whole, of a candidate's
surroundings 24 characters to either side are read, and a spelled-out address
has a local part of 64 characters at most; an empty table gives no rows (and EM
keeps its start values); extra columns are ignored (``redact`` carries them along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm import weak
from pagetide.llm.common import documents, let, materialize, regex_spans, text_or_empty

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "ssn", "iban", "secret"]
THRESHOLD = 0.5

# Base patterns of the contract, written so that Java's engine neither
# backtracks over long runs nor recurses: possessive repeats, and a start only
# where a run starts (or the match before ended).
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# further patterns: (kind, pattern, strict)
MORE = [
    ("email", r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,4}", True),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", False),
    ("ssn", r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])", False),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", False),
    ("secret", r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?[^\s\"',;]{6,}+", True),
]

# fixed values: gazetteers
TLDS = "com org net edu gov io info biz de fr es uk it nl eu ch at us ca au jp cn in br co me".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 380 420 421 852 886 971 972".split()
CUES = {
    "email": "mail|contact|write to|reach|address",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": "card|visa|master|amex|credit|payment|account",
    "phone": "phone|call|tel|mobile|cell|fax|contact|whatsapp",
    "ssn": r"ssn|social security|\bss#",
    "iban": "iban|bank|account|transfer",
    "secret": "login|user|credential|config|key",
}
NOT_CUES = r"(?i)(?:version|\bv\.?|chapter|section|isbn|issn|page|fig\.?|no\.|[$€£#])\s*$"

VOTES = ["v_regex", "v_gazetteer", "v_context", "v_shape", "v_boundary"]
FEATURES = ["kind", "f_length", "f_digits", "f_edge"]
SPAN = (
    "array<struct<kind:string,start:bigint,stop:bigint,base:boolean,"
    "v_regex:int,v_gazetteer:int,v_context:int,v_shape:int,v_boundary:int,"
    "f_length:int,f_digits:int,f_edge:int>>"
)


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + (2 * c.cast("int") / 10).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    if kind == "ip":
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _fields(kind: str, base: bool, strict: bool):
    def fields(start, stop, hit, before, after):
        near = F.right(before, F.lit(24))
        digits = F.char_length(F.regexp_replace(hit, "[^0-9]", ""))
        n = F.char_length(hit)
        if kind == "email":
            tld = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
            gazetteer = F.when(tld.isin(TLDS), 1).otherwise(-1)
        elif kind == "phone":
            code = F.regexp_replace(hit, "[^0-9]", "")
            known = F.lit(False)
            for width in (1, 2, 3):
                known = known | F.left(code, F.lit(width)).isin([c for c in COUNTRY_CODES if len(c) == width])
            gazetteer = F.when(hit.startswith("+") & known, 1).when(hit.startswith("+"), -1).otherwise(0)
        elif kind == "card":
            gazetteer = F.when(hit.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)
        else:
            gazetteer = F.lit(0)
        if kind == "secret":
            value = F.regexp_extract(hit, r"[=:][\x20\t]{0,3}[\"']?(.*)$", 1)
            shape = F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.char_length(value) >= 10), 1).when(~value.rlike("[0-9]"), -1).otherwise(0)
        else:
            bare = F.regexp_replace(hit, "[^A-Za-z0-9]", "")
            shape = F.when(bare.rlike(r"^(.)\1*$"), -1).otherwise(1)
        edge = F.when(F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") | F.left(after, F.lit(1)).rlike("[A-Za-z0-9]"), 0).otherwise(1)
        context = F.when(near.rlike(NOT_CUES), -1).when(near.rlike(f"(?i)(?:{CUES[kind]})"), 1).otherwise(0)
        return (
            F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"),
            F.lit(base).alias("base"),
            F.lit(1 if strict else 0).alias("v_regex"),
            gazetteer.alias("v_gazetteer"), context.alias("v_context"), shape.alias("v_shape"),
            F.when(edge == 1, 1).otherwise(-1).alias("v_boundary"),
            F.least(n / 4, F.lit(12)).cast("int").alias("f_length"),
            F.floor(4 * digits / n).cast("int").alias("f_digits"),
            edge.alias("f_edge"),
        )

    return fields


def _base_spans(text: Column, kind: str, pattern: str) -> Column:
    return regex_spans(text, F.lit(pattern), _fields(kind, True, True), SPAN, lambda hit: base_valid(kind, hit))


def candidates(text: Column) -> Column:
    """All candidate spans of a text: valid base spans first by kind and start,
    then the others that do not lie inside one of them (they may overlap)."""
    none = F.array().cast(SPAN)
    digits = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")) & digits}
    base = [
        F.when(gates.get(k, digits), _base_spans(text, k, p)).otherwise(none)
        for k, p in BASE.items()
    ]
    more_gates = {
        "email": text.rlike(r"(?:\[at\]|\(at\))"),
        "secret": text.rlike(r"(?i)(?:password|passwd|pwd|secret|token|key)[\"']?[\x20\t]{0,3}[=:]"),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
    }
    more = [
        F.when(more_gates.get(k, digits), regex_spans(text, F.lit(p), _fields(k, False, strict), SPAN)).otherwise(none)
        for k, p, strict in MORE
    ]
    clear = lambda found: F.filter(F.concat(*more), lambda s: ~F.exists(found, lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return let(F.concat(*base), lambda found: F.concat(found, clear(found)))


def label(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, ``base`` and ``spans`` (arrays of spans).

    Candidates are written once to the shared folder; counting votes, fitting
    the classifier and the result read these files.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("_text"))
    found = src.withColumn("_spans", candidates(F.col("_text"))).drop("_text")
    found = materialize(found, "pii-candidates")
    spans = found.filter(F.size("_spans") > 0).select(F.explode("_spans").alias("s")).select("s.*")
    model = weak.fit(spans, VOTES, 0.7, (0.05, 0.35, 0.6), (0.45, 0.4, 0.15))
    classifier = weak.fit_naive_bayes(spans, FEATURES, model.posterior())

    def accepted(s):
        p = (classifier.probability(lambda c: s[c]) + model.posterior(lambda c: s[c])) / 2
        return s["base"] | (p >= THRESHOLD)

    return found.withColumns({
        "base": F.filter("_spans", lambda s: s["base"]),
        "spans": F.filter("_spans", accepted),
    }).drop("_spans")


def _digest_text(spans: Column) -> Column:
    """kind:start:stop of spans by kind as listed, then start, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            F.array_position(order, s["kind"]).alias("k"), s["start"].alias("a"), s["stop"].alias("b"),
            F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")).alias("t"),
        ),
    )
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: s["t"]), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each accepted span of ``text`` replaced by ``<KIND>``; a
    column ``n_chars`` is counted anew where a text changed."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    df = label(packed, ["_row"])
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    text = F.col("_row")["text"]

    def step(acc, s):
        # overlapping spans merge into the mark of the first
        more = F.when(
            s["start"] >= acc["at"],
            F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))),
        ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), more.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        ordered, zero, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))),
    )
    df = df.withColumn("_clean", F.when(F.size("spans") == 0, text).otherwise(clean))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        old = F.col("_row")["n_chars"]
        new["n_chars"] = F.when(F.size("spans") == 0, old).otherwise(F.char_length("_clean").cast(kind))
    return df.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    df = label(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select(
        "doc_id", *[count(k) for k in BASE_KINDS],
        F.sha2(_digest_text(F.col("base")), 256).alias("base_sha256"),
        _digest_text(F.col("spans")).alias("spans"),
    )
