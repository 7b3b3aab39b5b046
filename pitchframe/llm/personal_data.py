"""Personal data by weak supervision, in DataFrame operations throughout.

Fixed patterns give the base spans. Looser patterns propose further spans.
Regex, gazetteer, context and checksum labelers vote on both; expectation
maximisation over the vote patterns estimates how reliable each labeler is; the
resulting probabilities train a classifier on the shape of a span, which decides
about the proposed ones. Text never leaves the JVM, and what reaches the driver
is one row per vote pattern and per feature value.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import save

KINDS = ["email", "ip", "card", "phone"]
# Each is equal to the plain pattern of its kind, written so that a match is tried once per run of characters
# (possessive, anchored at the run's start or the last match's end): linear time and no recursion on any text.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[A-Za-z0-9._%+-]{{1,64}}+(?: @ ?|@ | ?[\[(]at[\])] ?)[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{{2,63}}+){{1,8}}+",
    "phone": r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9] )\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,14}(?![0-9A-Za-z]|[\x20().-]{1,2}[0-9])",
}
# What a labeler looks for around or inside a span.
TOP_DOMAINS = "com org net edu gov io de fr es uk eu info"
CUES = {
    "email": "mail email e-mail contact write correo courriel kontakt",
    "ip": "ip host server address addr adresse",
    "card": "card visa mastercard credit carte karte tarjeta payment",
    "phone": "phone tel call fax mobile telephone telefon tél teléfono",
}
COUNTER_CUES = "order version isbn item serial invoice ticket commit hash total"
CONTEXT = 40
LABELERS = ["shape", "gazetteer", "context", "counter", "checksum", "digits"]
ROUNDS = 40
ACCEPT = 0.5


def _occurrences(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Add ``name``: structs ``start, end`` (code points), ``match`` of the leftmost matches, in order.

    Starts are running sums of the lengths between and of the matches, taken in
    blocks of about sqrt(n) so that many matches in one text stay cheap.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("found", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("gaps", F.when(F.size("found") > 0, F.transform(F.split("text", pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("steps", F.expr("transform(found, (m, i) -> gaps[i] + if(i > 0, char_length(found[i - 1]), 0))"))
    df = df.withColumn("block", F.expr("cast(ceil(sqrt(size(found))) as int)"))
    total = "aggregate(slice({0}, {1}, {2}), 0, (a, x) -> a + x)"
    df = df.withColumn("blocks", F.expr(f"if(size(found) = 0, array(), transform(sequence(0, (size(found) - 1) div block), b -> {total.format('steps', 'cast(b * block + 1 as int)', 'block')}))"))
    df = df.withColumn("before", F.expr(f"transform(blocks, (x, b) -> {total.format('blocks', '1', 'b')})"))
    start = f"before[i div block] + {total.format('steps', 'cast(i - i % block + 1 as int)', 'i % block + 1')}"
    df = df.withColumn(name, F.expr(f"transform(found, (m, i) -> named_struct('start', {start}, 'match', m))"))
    df = df.withColumn(name, F.expr(f"transform({name}, s -> named_struct('start', s.start, 'end', s.start + char_length(s.match), 'match', s.match))"))
    return df.drop("found", "gaps", "steps", "block", "blocks", "before")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _validity(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["match"])


def _all_described(kind: str, spans: Column, base: bool) -> Column:
    return F.transform(spans, lambda span: _described(kind, span, base))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _described(kind: str, span: Column, base: bool) -> Column:
    """The votes (1, -1, 0) and features of a span."""
    match = span["match"]
    before = F.lower(F.substring(F.col("text"), F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT))))
    digits = _digits(match)
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    word = lambda words: rf"(?<!\p{{L}})(?:{'|'.join(words.split())})(?!\p{{L}})"
    last = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    lengths = {"email": (6, 80), "ip": (4, 12), "card": (13, 19), "phone": (10, 13)}[kind]
    size = F.char_length(match) if kind == "email" else F.length(digits)
    known = last.isin(TOP_DOMAINS.split())
    votes = {
        "shape": F.lit(1 if base else 0),
        "gazetteer": vote(known, ~known) if kind == "email" else F.lit(0),
        "context": vote(before.rlike(word(CUES[kind]))),
        "counter": vote(F.lit(False), before.rlike(word(COUNTER_CUES))),
        "checksum": vote(F.lit(base), ~_luhn(digits) & (F.length(digits) > 15)) if kind in ("card", "phone") else F.lit(0),
        "digits": vote(size.between(*lengths), ~size.between(*lengths)),
    }
    features = F.array(
        F.lit(f"kind={kind}"),
        F.concat(F.lit("size="), F.least(size, F.lit(40)).cast("string")),
        F.concat(F.lit("separators="), F.regexp_replace(F.regexp_replace(match, r"[A-Za-z0-9]+", "a"), "(.)\\1+", "$1").substr(1, 12)),
        F.concat(F.lit("domain="), known.cast("string")),
    )
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
        F.struct(*[votes[name].alias(name) for name in LABELERS]).alias("votes"), features.alias("features"),
    )


def spans_of(docs: DataFrame, text_col: str) -> DataFrame:
    """``row`` (the columns of ``docs``), ``text``, and ``base``, ``loose`` with the described spans of each text."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sign = {"email": "@", "ip": ".", "phone": "+"}
    for kind in KINDS:
        df = _occurrences(df, f"base_{kind}", BASE[kind], F.contains("text", F.lit(sign[kind])) if kind in sign else F.lit(True))
        df = df.withColumn(f"base_{kind}", _all_described(kind, F.filter(f"base_{kind}", _validity(kind)), True))
    for kind, pattern in LOOSE.items():
        guard = F.col("text").rlike("@|[\\[(]at[\\])]") if kind == "email" else F.lit(True)
        df = _occurrences(df, f"loose_{kind}", pattern, guard)
        df = df.withColumn(f"loose_{kind}", _all_described(kind, F.col(f"loose_{kind}"), False))
    base = F.concat(*[f"base_{kind}" for kind in KINDS])
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.select("row", "text", base.alias("base"), F.concat(*[f"loose_{kind}" for kind in LOOSE]).alias("loose"))
    return df.withColumn("loose", F.filter("loose", apart))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """The probability of personal data for each vote pattern, by expectation maximisation over ``(votes, count)``.

    It starts from the mean vote; votes are independent given the truth, and
    abstentions say nothing. Counts are smoothed towards a labeler that is right
    four times in five.
    """
    chance = [min(max(0.5 + sum(v) / (2 * max(1, sum(map(abs, v)))), 0.1), 0.9) for v, _ in patterns]
    for _ in range(ROUNDS if patterns else 0):
        total = sum(n for _, n in patterns)
        prior = (sum(p * n for p, (_, n) in zip(chance, patterns, strict=True)) + 1) / (total + 2)
        weights = []
        for k in range(len(LABELERS)):
            right = {}
            for truth in (0, 1):
                mass = {vote: 4.0 if (vote > 0) == bool(truth) else 1.0 for vote in (-1, 1)}
                for p, (votes, n) in zip(chance, patterns, strict=True):
                    if votes[k]:
                        mass[votes[k]] += n * (p if truth else 1 - p)
                right[truth] = {vote: m / sum(mass.values()) for vote, m in mass.items()}
            weights.append({vote: log(right[1][vote] / right[0][vote]) for vote in (-1, 1)} | {0: 0.0})
        odds = [log(prior / (1 - prior)) + sum(w[v] for w, v in zip(weights, votes, strict=True)) for votes, _ in patterns]
        chance = [1 / (1 + exp(-min(max(o, -30), 30))) for o in odds]
    return chance


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """The log odds of each feature value and the prior log odds, from a written table with ``base`` and ``loose``."""
    spark = found.sparkSession
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.votes", "s.features")
    patterns = [(tuple(row["votes"]), row["count"]) for row in spans.groupBy("votes").count().orderBy("votes").collect()]
    rows = [(*votes, p) for (votes, _), p in zip(patterns, reliabilities(patterns), strict=True)]
    chances = spark.createDataFrame(rows, ", ".join(f"{name} int" for name in LABELERS) + ", p double")
    weighed = spans.select("votes.*", "features").join(F.broadcast(chances), LABELERS).select("p", F.explode("features").alias("feature"))
    table = weighed.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).orderBy("feature").collect()
    yes, no = (sum(row[side] for row in table if row["feature"].startswith("kind=")) for side in ("yes", "no"))
    odds = {row["feature"]: log((row["yes"] + 0.5) / (yes + 1)) - log((row["no"] + 0.5) / (no + 1)) for row in table}
    return odds, log((yes + 1) / (no + 1))


def _decided(found: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """``found`` with ``base`` and ``spans`` as arrays of ``start, kind, end``."""
    odds, prior = model
    literal = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair]) if odds else F.create_map().cast("map<string,double>")
    accept = log(ACCEPT / (1 - ACCEPT))
    score = lambda s: F.aggregate(s["features"], F.lit(prior), lambda a, f: a + F.coalesce(literal[f], F.lit(0.0)))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    more = F.filter("loose", lambda s: score(s) > accept)
    found = found.withColumn("spans", F.array_sort(F.transform(F.concat("base", more), plain)))
    return found.withColumn("base", F.array_sort(F.transform("base", plain)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` of each row: arrays of ``start, kind, end`` in order of start, then kind.

    ``base`` holds the spans of the fixed patterns, ``spans`` also the accepted
    proposals, which overlap none of them. Places count code points.

    Defined cases: a null or empty text has no spans; repeated rows and null keys
    each keep their row; an empty table gives no row; other columns are ignored;
    a very long text is scanned in linear time. No shuffle of texts.
    """
    found = save(spans_of(docs.select(id_col, text_col), text_col).select(F.col(f"row.{id_col}").alias("doc_id"), "base", "loose"), "spans")
    return _decided(found, train(found)).select("doc_id", "base", "spans")


def joined(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of each text replaced by its kind in angle brackets; all rows and columns stay.

    Of overlapping spans the first names the whole. Null texts stay null. The
    spans are those of :func:`personal_data` on the same table.
    """
    model = train(save(spans_of(docs.select(text_col), text_col).select("base", "loose"), "spans"))
    names = F.array(*map(F.lit, KINDS))

    def step(done: Column, s: Column) -> Column:
        inside = s["start"] < done["at"]
        piece = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.lit("<"), names[s["kind"]], F.lit(">"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(inside, done["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.char_length("text")))
    df = _decided(spans_of(docs, text_col), model)
    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("row")[text_col])
    return df.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
