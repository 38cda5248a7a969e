"""Column builders on small inputs worked out by hand."""

from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import routing as Q
from quarry.functions import text as T
from quarry.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_trigrams(spark):
    r = one(
        spark, t=T.trigrams(F.lit("Cat ca")), s=T.trigram_similarity(T.trigrams(F.lit("cat")), T.trigrams(F.lit("cab"))),
        none=T.trigram_similarity(T.trigrams(F.lit("")), T.trigrams(F.lit(None).cast("string"))),
    )
    assert r["t"] == ["  c", " ca", "cat", "at ", "ca "] and abs(r["s"] - 2 / 6) < 1e-9 and r["none"] == 0


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(
        spark, same=V.cosine(arr(1, 2), arr(1, 2)), across=V.cosine(arr(1, 0), arr(0, 1)), against=V.cosine(arr(1, 0), arr(-1, 0)),
        zero=V.cosine(arr(0, 0), arr(1, 0)), other=V.cosine(arr(1), arr(1, 0)), lit=V.cosine(V.literal([3, 4]), arr(3, 4)),
    )
    assert abs(r["same"] - 1) < 1e-12 and r["across"] == 0 and r["against"] == -1 and r["zero"] is None and r["other"] is None and abs(r["lit"] - 1) < 1e-12


def test_titles(spark):
    long = "word " * 20
    r = one(spark, short=T.title(F.lit("  hi\n")), cut=T.title(F.lit(long)), solid=T.title(F.lit("x" * 60)), lead=T.title(F.lit("y" * 49 + " z" * 9)))
    assert r["short"] == "hi" and r["cut"] == long[:49].rstrip() + "..." and r["solid"] == "x" * 50 + "..." and r["lead"] == "y" * 49 + "..."
    r = one(spark, bug=T.title_sign(F.lit("A Bug in tests")), ci=T.title_sign(F.lit("decide")), none=T.title_sign(F.lit(None).cast("string")))
    assert (r["bug"], r["ci"], r["none"]) == ("🐛", "🚀", "💬")


def test_redaction(spark):
    token = "gh" + "p_" + "a" * 36
    r = one(
        spark, t=T.redact(F.lit(f"Authorization: bearer abc.def== and {token} PASSWORD: hunter2, api-key=x1")),
        m=T.redact_map(F.create_map(F.lit("apiKey"), F.lit("v"), F.lit("note"), F.lit("secret=1 ok"))),
    )
    assert r["t"] == "Authorization: [REDACTED] and [REDACTED] [REDACTED], [REDACTED]"
    assert r["m"] == {"apiKey": "[REDACTED]", "note": "[REDACTED] ok"}


def test_dates(spark):
    now = F.to_timestamp(F.lit("2026-01-10 15:00:00"))  # a Saturday
    at = lambda s: F.to_timestamp(F.lit(s))
    cases = {"2026-01-10 00:00:00": "today", "2026-01-09 23:59:59": "yesterday", "2026-01-05 00:00:00": "this_week", "2026-01-04 23:00:00": "this_month", "2025-12-31 10:00:00": "older"}
    r = one(spark, **{f"c{i}": T.calendar_group(at(s), now) for i, s in enumerate(cases)})
    assert [r[f"c{i}"] for i in range(len(cases))] == list(cases.values())
    r = one(spark, a=T.rolling_group(at("2026-01-09 16:00:00"), now), b=T.relative_time(at("2026-01-10 14:58:00"), now), c=T.relative_time(at("2026-01-02 14:00:00"), now), d=T.relative_time(at("2026-01-10 14:59:30"), now))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("today", "il y a 2 minutes", "il y a 1 semaine", "à l'instant")


def test_small_texts(spark):
    r = one(
        spark, tokens=T.estimate_tokens(F.lit("12345")), base=T.basename(F.lit("a/b/c.ts")), arr=T.json_array(F.lit('say ["a","b"] end')), none=T.json_array(F.lit("x")),
        key=T.client_key(F.lit(None).cast("string"), F.lit(" 1.2.3.4, 5")), unknown=T.client_key(F.lit(None).cast("string"), F.lit(None).cast("string")),
        lines=T.line_range(F.lit(3), F.lit(9)), single=T.line_range(F.lit(3), F.lit(3)), uuid=T.is_uuid(F.lit("123E4567-e89b-12d3-a456-426614174000")),
        parts=T.message_text(F.lit(None).cast("string"), F.from_json(F.lit('[{"type":"text","text":"a"},{"type":"x","text":"b"},{"type":"text","text":"c"}]'), "array<struct<type: string, text: string>>")),
        joined=T.sections(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")), k=T.abbreviated(F.lit(1500)), m=T.abbreviated(F.lit(2_340_000)),
    )
    assert (r["tokens"], r["base"], r["arr"], r["none"]) == (2, "c.ts", ["a", "b"], None)
    assert (r["key"], r["unknown"], r["lines"], r["single"], r["uuid"]) == ("ip:1.2.3.4", "unknown", "3-9", "3", True)
    assert (r["parts"], r["joined"], r["k"], r["m"]) == ("ac", "a\n\nb", "2k", "2.3M")


def test_line_marks(spark):
    none = F.lit(None).cast("int")
    r = one(
        spark, a=T.line_label(F.lit(3), F.lit(9)), b=T.line_label(F.lit(3), F.lit(3)), c=T.line_label(F.lit(3), none), d=T.line_label(none, F.lit(3)),
        e=T.line_hash(F.lit(3), F.lit(9)), f=T.line_hash(F.lit(3), none), g=T.line_hash(none, none),
    )
    assert list(r) == [":3-9", ":3", ":3", "", "#L3-L9", "#L3", ""]


def test_paths(spark):
    rows = {
        "src/App.tsx": ("typescript", True), "node_modules/x.js": ("javascript", False), "a/b.min.js": ("javascript", False), "Makefile": ("text", False),
        "img/a.PNG": ("text", False), "lib/x.d.ts": ("typescript", False), "a/package-lock.json": ("json", False), "a/Dockerfile": ("text", False), "x.prisma": ("prisma", True),
    }
    df = spark.createDataFrame([(p,) for p in rows], "path string").select("path", P.language(F.col("path")).alias("l"), P.is_included(F.col("path")).alias("i"))
    assert {r["path"]: (r["l"], r["i"]) for r in df.collect()} == rows


def test_ignore_rules(spark):
    rules = P.ignore_rules("# c\n\n *.log \n/only\nbuild/\n!keep\n**/gen/*.ts\na?c\n[bad\n")
    assert rules == ["*.log", "/only", "build/", "**/gen/*.ts", "a?c", "[bad"]
    want = {
        "x.log": True, "d/x.log": True, "x.logs": False, "only": True, "only/a": True, "d/only": False, "build/a": True, "d/build/a": True, "build": False,
        "gen/a.ts": True, "p/gen/a.ts": True, "gen/d/a.ts": False, "abc": True, "a/c": False, "keep": False,
    }
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", P.is_ignored(F.col("p"), rules).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == want


def test_routing(spark):
    cases = {
        "getUser": ("identifier", "GENERIC"), "what is x.y(1)?": ("code", "GENERIC"), "list all api routes": ("natural_language", "API_ROUTES"),
        "rapid building": ("natural_language", "API_ROUTES"), "show the database tables": ("natural_language", "SCHEMA"), "hello there": ("natural_language", "GENERIC"),
    }
    q = F.col("q")
    df = spark.createDataFrame([(c,) for c in cases], "q string").select("q", Q.form(q).alias("form"), Q.classified(Q.subject_scores(q), q).alias("s"), Q.strategy(q, Q.classified(Q.subject_scores(q), q)).alias("st"))
    got = {r["q"]: r for r in df.collect()}
    assert {k: (v["form"], v["s"]["type"]) for k, v in got.items()} == cases
    assert got["getUser"]["st"] == "symbol" and got["list all api routes"]["st"] == "metadata" and got["hello there"]["st"] == "hybrid_v2"
    models = {"write a function that sorts": ("complex", "chat"), "why is it so": ("complex", "chat"), "what is this": ("simple", "haiku"), "a b c": ("simple", "haiku"), "n " * 60: ("complex", "chat"), "one two three four five six seven eight nine": ("moderate", "chat")}
    df = spark.createDataFrame([(m,) for m in models], "q string").select("q", Q.model(q).alias("m"), Q.model(q, F.lit(6000)).alias("big"))
    rows = df.collect()
    assert {r["q"]: (r["m"]["complexity"], r["m"]["model"]) for r in rows} == models
    assert all(r["big"]["model"] == "chat" for r in rows) and {round(r["big"]["confidence"], 3) for r in rows if r["m"]["model"] == "haiku"} == {0.72, 0.63}
    r = one(spark, w=Q.expanded_words(F.lit("how does auth flow work")), p=Q.path_patterns(F.array(F.lit("auth"), F.lit("auth")), F.lit(True)))
    assert r["w"] == ["does", "auth", "flow", "work"] and r["p"] == ["%auth%", "%lib/%", "%api/%", "%services/%", "%config%"]
    r = one(spark, f=Q.strategy(F.lit("x"), F.struct(F.lit("A").alias("type"), F.lit(True).alias("is_list"), F.lit(1.0).alias("confidence")), forced=F.lit("vector")))
    assert r["f"] == "vector"
