"""Line triage: benign pre-filter, noise filter, payload extraction, access-log parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import patterns as p
from hostvigil.operators.ordered import evaluate_once
from hostvigil.functions.text import fold_case, is_blank, java_regex, matches, sanitize, strip

def _first_true(tests: list[tuple[Column, Column]]) -> Column:
    chain = F.when(*tests[0])
    for test in tests[1:]:
        chain = chain.when(*test)
    return chain


def first_benign_pattern(line: Column, folded: Column) -> Column:
    """Zero-based index of the first benign pattern that matches, NULL if none does.

    A substring test guards each run of patterns, so most lines meet no regex at all.
    """
    runs, start = [], 0
    for guard, size in p.BENIGN_GUARDS:
        numbers = range(start, start + size)
        run = _first_true([(matches(line, p.BENIGN_PATTERNS[i]), F.lit(i)) for i in numbers])
        runs.append(run if guard is None else F.when(folded.contains(guard), run))
        start += size
    return F.coalesce(*runs)


def prefilter_classify(lines: DataFrame, enabled: bool = True) -> DataFrame:
    """Add decision, reason and matched_pattern: BENIGN, SUSPICIOUS or PASS_TO_AI."""
    if not enabled:
        return lines.select(
            "*",
            F.lit("PASS_TO_AI").alias("decision"),
            F.lit("Pre-filter disabled").alias("reason"),
            F.lit(None).cast("string").alias("matched_pattern"),
        )
    line = F.col("raw_line")
    keywords = _first_true([(F.col("_folded").contains(k.lower()), F.lit(i)) for i, k in enumerate(p.OVERRIDE_KEYWORDS)])
    found = (
        lines.withColumn("_blank", is_blank(line))
        .withColumn("_folded", fold_case(line))
        .withColumn("_pattern", F.when(~F.col("_blank"), first_benign_pattern(line, F.col("_folded"))))
        .withColumn("_keyword", F.when(F.col("_pattern").isNotNull(), keywords))
    )
    pattern = F.get(F.lit(p.BENIGN_PATTERNS), F.col("_pattern"))
    keyword = F.get(F.lit([escaped_keyword(k) for k in p.OVERRIDE_KEYWORDS]), F.col("_keyword"))
    decision = (
        F.when(F.col("_blank"), "BENIGN")
        .when(F.col("_pattern").isNull(), "PASS_TO_AI")
        .when(F.col("_keyword").isNull(), "BENIGN")
        .otherwise("SUSPICIOUS")
    )
    reason = (
        F.when(F.col("_blank"), "Empty log line")
        .when(F.col("_pattern").isNull(), "No benign pattern matched, requires AI analysis")
        .when(F.col("_keyword").isNull(), F.concat(F.lit("Matched benign pattern: "), pattern))
        .otherwise(F.concat(F.lit("Benign pattern matched but suspicious keyword detected: "), keyword))
    )
    return found.select(
        *[F.col(c) for c in lines.columns],
        decision.alias("decision"),
        reason.alias("reason"),
        pattern.alias("matched_pattern"),
    )


def escaped_keyword(keyword: str) -> str:
    """The keyword as the reason text shows it: regex metacharacters, blanks, ``#``, ``&``, ``~`` and ``-`` escaped."""
    return "".join("\\" + ch if ch in "()[]{}?*+-|^$\\.&~# \t\n\r\v\f" else ch for ch in keyword)


def guarded_match(line: Column, folded: Column, table: list[str], guards: list[list[str]]) -> Column:
    """Whether any pattern matches: one alternation, tried only where one of the patterns' literals occurs."""
    literals = dict.fromkeys(x for own in guards for x in own)
    return any_true([folded.contains(x) for x in literals]) & matches(line, "|".join(f"(?:{pattern})" for pattern in dict.fromkeys(table)))


def any_true(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_noisy(line: Column, folded: Column) -> Column:
    """Blank, or a line of routine service chatter; ``folded`` is the line in fold_case."""
    chatter = any_true([F.lower(line).contains(s) for s in p.NOISE_SUBSTRINGS])
    table, guards = p.NOISE_PATTERNS + p.EXTRA_NOISE_PATTERNS, p.NOISE_GUARDS + p.EXTRA_NOISE_GUARDS
    return is_blank(line) | chatter | guarded_match(line, folded, table, guards)


def with_noise(lines: DataFrame) -> DataFrame:
    """Add _folded and _noisy, each a step of its own: steps stay small enough to be compiled."""
    folded = evaluate_once(lines.withColumn("_folded", fold_case(F.col("raw_line"))), "_folded")
    return evaluate_once(folded.withColumn("_noisy", is_noisy(F.col("raw_line"), F.col("_folded"))), "_noisy")


def drop_noise(lines: DataFrame) -> DataFrame:
    """The lines that are no noise."""
    return with_noise(lines).where("NOT _noisy").select(*lines.columns)


def with_clean_text(lines: DataFrame, spare: Column | None = None) -> DataFrame:
    """Add clean_text: the payload of a line by its source; NULL where the line is noise or holds none.

    ``spare`` marks lines the noise filter does not apply to.
    """
    noisy = F.col("_noisy") if spare is None else F.col("_noisy") & ~spare
    kept = with_noise(lines).withColumn("_line", F.when(~noisy, strip(F.col("raw_line")))).withColumn("_source", F.lower(F.coalesce("source_log", F.lit(""))))
    secure = F.col("_line").isNotNull() & guarded_match(F.col("_line"), F.col("_folded"), p.SECURITY_PATTERNS, p.SECURITY_GUARDS)
    marked = evaluate_once(kept.withColumn("_secure", secure), "_line", "_source", "_secure")
    found = evaluate_once(marked.withColumn("_payload", _payload(F.col("_line"), F.col("_source"), F.col("_secure"))), "_payload")
    text = F.when(F.col("_payload").isNotNull(), sanitize(F.col("_payload")))
    return found.select(*lines.columns, F.nullif(text, F.lit("")).alias("clean_text"))


def _payload(line: Column, source: Column, secure: Column) -> Column:
    """First rule whose source and pattern fit; a rule whose pattern does not match falls through to the next.

    ``secure`` says that one of the security patterns matches.
    """

    def from_source(*names: str) -> Column:
        return any_true([source.contains(n) for n in names])

    def rule(where: Column, pattern: str, prefix: str = "") -> tuple[Column, Column]:
        spelled = java_regex(pattern, ignore_case=False)
        found = F.regexp_extract(line, spelled, 1)
        return where & line.rlike(spelled), F.concat(F.lit(prefix), found) if prefix else found

    login = from_source("auth", "secure") | line.contains("sshd")
    return _first_true(
        [
            rule(from_source("access", "nginx", "apache"), p.QUOTED_REQUEST),
            rule(login, p.SSHD_MESSAGE),
            rule(login, p.SUDO_MESSAGE),
            rule(from_source("fail2ban"), p.FAIL2BAN_MESSAGE),
            rule(from_source("audit"), p.AUDIT_EXECUTABLE, "Executed binary: "),
            (secure, F.regexp_replace(line, java_regex(p.SYSLOG_PREFIX, ignore_case=False), "")),
        ]
    )


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Add ip, endpoint without its query string, method and status; drop lines of another shape.

    One rewrite captures all four fields at once. No field holds white space, so a line feed separates them, and the
    rewritten line always differs from the line.
    """
    spelled = java_regex(p.ACCESS_LINE + "(?s:.*)", ignore_case=False)
    line = F.col("raw_line")
    fields = lines.withColumn("_rewritten", F.regexp_replace(line, spelled, "$1\n$2\n$3\n$4"))
    fields = fields.withColumn("_f", F.when(F.col("_rewritten") != line, F.split("_rewritten", "\n")))
    return evaluate_once(fields, "_f").where("_f IS NOT NULL").select(
        *lines.columns,
        F.get("_f", F.lit(0)).alias("ip"),
        F.split(F.get("_f", F.lit(2)), "\\?", 2)[0].alias("endpoint"),
        F.get("_f", F.lit(1)).alias("method"),
        F.get("_f", F.lit(3)).try_cast("long").alias("status"),
    )
