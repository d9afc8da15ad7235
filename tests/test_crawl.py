"""Runs from sources to a written catalog, containment, longest matches, redirects in rounds."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import crawl, robots
from cairn.operators.assemble import RunError
from cairn.operators.structural import enclosing
from cairn.sources import page_parsers, pages

SITE, DOCS = "site.example.net", "docs.example.net"
HEAD = "<html><head><title>T</title><link rel=canonical href='{}'><meta name=description content='{}'></head><body>"
OVERVIEW = HEAD.format("/overview", "All") + '<figure><figcaption>Fast</figcaption><a href="/products/a"><div><strong>A</strong></div><p>About a</p></a></figure>'
PRODUCT = HEAD.format("/products/a", "A, in full") + '<h1 data-cms-path="products.a.sections.hero.title">A</h1><p data-cms-path="products.a.sections.useCases.items.1.title">Speed</p><p data-cms-path="products.a.sections.useCases.items.1.description">{}</p>'
SOLUTION = HEAD.format("/solutions/s", "S, in full") + '<p data-cms-path="pages.s.hero.eyebrow">S</p><p data-cms-path="pages.s.useCases.items.1.title">Speed</p><p data-cms-path="pages.s.useCases.items.1.description">Go</p>'
SOLUTIONS = HEAD.format("/solutions", "All") + '<div><a href="/solutions/s" aria-label="See solution about S"></a><p data-cms-path="pages.solutions-page.benefits.1.title"><strong>S</strong></p><i></i><p data-cms-path="pages.solutions-page.benefits.1.description">Of s</p></div>'
GUIDE = HEAD.format("/a", "Guide") + '<main data-pagefind-body><a href="/a/"><span>A</span><p>Docs of a</p></a><a href="/x">up</a></main>'


def inputs(spark, **changed):
    """Sources, robots answers and page answers of a sound run, with changes: a URL's answer, or robots of a host."""
    listed = [("over", f"https://{SITE}/overview", "marketing-overview"), ("sols", f"https://{SITE}/solutions", "marketing-overview"), ("prod", f"https://{SITE}/products/a", "marketing-product"), ("sol", f"https://{SITE}/solutions/s", "marketing-solution"), ("docs", f"https://{DOCS}/a", "developer-docs")]
    bodies = {"over": OVERVIEW, "sols": SOLUTIONS, "prod": PRODUCT.format("Go"), "sol": SOLUTION, "docs": GUIDE}
    answers = {k: (200, None, bodies[k]) for k, _, _ in listed} | {k: v for k, v in changed.items() if k in bodies}
    hosts = {SITE: (404, None), DOCS: (200, "user-agent: *\ndisallow: /private")} | changed.get("robots", {})
    rows = [(u, *answers[k], "2026-01-02T03:04:05.000Z") for k, u, _ in listed] + changed.get("more", [])
    return (
        spark.createDataFrame([(n, *x) for n, x in enumerate(listed)], "ord int, id string, url string, page_kind string"),
        spark.createDataFrame([(h, *x) for h, x in hosts.items()], "host string, status int, body string"),
        spark.createDataFrame(rows, "url string, status int, location string, html string, retrieved_at string"),
    )


def done(spark, **changed):
    return crawl.run(*inputs(spark, **changed), "bot", [SITE, DOCS], 1000, DOCS)


def failed(run):
    return [(r.ord, r.stage, r.subject, r.message) for r in crawl.in_stages(run.failures).collect()]


def test_sound_run(spark, tmp_path):
    run = done(spark)
    assert failed(run) == []
    assert crawl.lines(run, inputs(spark)[0]) == [f"config: 5 sources ({SITE} 4, {DOCS} 1)", "fetch: 5/5 pages fetched (robots-gated)", "parse: 5 pages parsed and normalized", "assemble: 1 families, 1 products, 1 solutions, 1 use cases, 2 relationships"]
    target = tmp_path / "catalog.json"
    crawl.write(run, str(target), "2026-01-02T03:04:06.000Z")
    once = target.read_bytes()
    crawl.write(done(spark), str(target), "2026-01-02T03:04:06.000Z")
    assert target.read_bytes() == once
    product = json.loads(once)["products"][0]
    assert product == {"id": "a", "name": "A", "summary": "A, in full", "familyId": "fast", "sourceIds": ["docs", "over", "prod"]}


def test_failures_of_all_stages_at_once(spark, tmp_path):
    """A server's error, a disallowed redirect, a page without its mark, a name without an id and a conflict, in one report."""
    target = tmp_path / "catalog.json"
    target.write_text("before")
    more = [(f"https://{DOCS}/private/a", 200, None, GUIDE, "x")]
    run = done(spark, over=(500, None, None), docs=(301, "/private/a", None), sol=(200, None, "<html></html>"), prod=(200, None, PRODUCT.format("Go").replace(">Speed<", ">!<")), more=more)
    assert failed(run) == [
        (4, "robots", f"https://{DOCS}/private/a", "path disallowed"), (0, "fetch", f"https://{SITE}/overview", "HTTP 500"), (3, "parse", f"https://{SITE}/solutions/s", "none of the kinds fit"),
        (None, "normalize", f"https://{SITE}/products/a", "no id from the name of card !"), (None, "normalize", "product a", f"incomplete: https://{SITE}/products/a"),
    ]
    assert run.counts["fetched"] == 3 and run.counts["parsed"] == 2
    with pytest.raises(RunError, match="HTTP 500"):
        crawl.write(run, str(target), "2026-01-02T03:04:06.000Z")
    assert target.read_text() == "before"


def test_conflict_of_equal_precedence(spark):
    assert failed(done(spark, prod=(200, None, PRODUCT.format("Come")))) == [(None, "normalize", "use case speed", f"conflicting summary between https://{SITE}/products/a and https://{SITE}/solutions/s")]


@pytest.mark.parametrize(("answer", "message"), [((503, None), "whole host is disallowed"), ((None, None), "robots.txt fetch failed"), ((200, "user-agent: *\ncrawl-delay: 5"), "crawl-delay exceeds the interval")])
def test_robots_stop_a_host(spark, answer, message):
    run = done(spark, robots={SITE: answer})
    assert [f[1:] for f in failed(run)][:4] == [("robots", f"https://{SITE}{p}", message) for p in ("/overview", "/solutions", "/products/a", "/solutions/s")]
    assert run.counts["fetched"] == 1
    assert failed(done(spark, robots={DOCS: (200, "user-agent: *\ncrawl-delay: 1\ndisallow: /b")})) == []


def test_containment_by_brute_force(spark):
    rng, rows = random.Random(2), []
    for page in range(12):
        at, stack, spans = 0, [], {}
        while at < 60 or stack:
            if stack and (rng.random() < 0.45 or at >= 60):
                spans[stack.pop()][1] = at - 1
            else:
                spans[at] = [at, at]
                if rng.random() < 0.7:
                    stack.append(at)
                at += 1
        rows += [(page, p, last, rng.choice("xyz"), rng.random() < 0.5) for p, last in spans.values()]
    df = spark.createDataFrame(rows, "page int, pos int, last int, depth string, step boolean").repartition(5)
    outer, inner = F.col("step"), F.col("depth") != "z"
    pairs = {(g, p, o) for g, p, _, d, _ in rows if d != "z" for h, o, last, _, s in rows if h == g and s and o < p <= last}
    assert {(r.page, r.pos, r.around) for r in enclosing(df, "page", outer, inner, every=True).collect()} == pairs
    near = {(g, p): max((o for h, q, o in pairs if (h, q) == (g, p)), default=None) for g, p, _, d, _ in rows if d != "z"}
    got = enclosing(df, "page", outer, inner)
    assert got.columns == [*df.columns, "around"] and {(r.page, r.pos): r.around for r in got.collect()} == near


def test_cards_in_linear_time(spark):
    """A page of a hundred thousand cards, for less than nine times what one of twenty thousand takes."""
    took = []
    for n in (2_000, 20_000, 100_000):
        cards = "".join(f'<a href="/products/p{k}"><div><strong>P {k}</strong></div><p>t</p></a>' for k in range(n))
        df = spark.createDataFrame([(1, f"https://{SITE}/overview", HEAD.format("/overview", "All") + f"<figure><figcaption>F</figcaption>{cards}</figure>")], "page_id int, url string, html string")
        began = time.perf_counter()
        row = page_parsers.parse(df).select(F.size("cards").alias("n"), "issue", F.get("cards", F.lit(n - 1))["name"].alias("last")).first()
        took.append(time.perf_counter() - began)
        assert (row.n, row.issue, row.last) == (n, None, f"P {n - 1}")
    assert took[2] < 9 * took[1]


def brute_allowed(rules, path):
    best = (-1, True)
    for allow, pattern in rules:
        regex = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$")) + ("$" if pattern.endswith("$") else "")
        if re.match(regex, path if path.startswith("/") else "/" + path):
            best = max(best, (len(pattern), allow))
    return best[1]


def test_longest_match_of_many_rules(spark):
    rng = random.Random(3)
    part = lambda: "/" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    rules = [(rng.random() < 0.5, "".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "", "$", "*", "*b", "/*/a$", "*$"))) for _ in range(400)] + [(True, "*aab$"), (False, "/")]
    body = "user-agent: *\n" + "\n".join(f"{'allow' if a else 'disallow'}: {p}" for a, p in rules)
    asked = list({"".join(part() for _ in range(rng.randint(1, 6)))[rng.randint(0, 1) :] for _ in range(300)})
    got = robots.decisions(spark.createDataFrame([("h", p) for p in asked], "host string, path string"), robots.parse(spark.createDataFrame([("h", body)], "host string, body string")), "bot")
    assert {r.path: r.allowed for r in got.collect()} == {p: brute_allowed(rules, p) for p in asked}


def test_many_rules_don_t_meet_every_path(spark):
    """A hundred thousand rules of one host and as many paths: ten billion pairs, if each met each."""
    body = "user-agent: *\n" + "\n".join(f"disallow: /p{k}/x{k % 7}" for k in range(100_000))
    paths = spark.range(100_000).select(F.lit("h").alias("host"), F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/x3/y")).alias("path"))
    got = robots.decisions(paths, robots.parse(spark.createDataFrame([("h", body)], "host string, body string")), "bot").groupBy("allowed").count().collect()
    assert {r.allowed: r["count"] for r in got} == {False: sum(k % 7 == 3 for k in range(100_000)), True: sum(k % 7 != 3 for k in range(100_000))}


def test_redirects_with_barred_urls(spark):
    asked = spark.createDataFrame([("https://h/a",), ("https://h/b",)], "url string")
    answers = spark.createDataFrame([("https://h/a", 301, "/c"), ("https://h/b", 200, None), ("https://h/c", 200, None)], "url string, status int, location string")
    got = pages.follow(asked, answers, ["h"], barred=spark.createDataFrame([("https://h/c",)], "url string"))
    assert sorted(tuple(r) for r in got.collect()) == [("https://h/a", "https://h/c", 301, 1, "vetoed"), ("https://h/b", "https://h/b", 200, 0, None)]


@pytest.mark.parametrize("most", [None, 3])
def test_places_within_keys(spark, most):
    """A key of most rows, null keys and keys of one row; ranges cut the large one."""
    from cairn.operators import places

    rng = random.Random(4)
    rows = [(rng.choice(("hot", "hot", "hot", "hot", "b", None)), rng.randrange(60), k) for k in range(600)] + [("one", 5, 600)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(3)
    want = set()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        n = len(own) if most is None else {"hot": 90, "b": 2, None: 0}.get(key, 0)
        want |= {(*r, place) for place, r in enumerate(own[:n], 1)}
    if most is None:
        got = places.placed_within(df, ["k"], ["v", "id"])
    else:
        limits = spark.createDataFrame([("hot", 90), ("b", 2), (None, 0)], "k string, n int")
        got = places.first_within(df, ["k"], ["v", "id"], limits)
        three = places.first_within(df, ["k"], ["v", "id"], 3).groupBy("k").agg(F.max("place").alias("m"), F.count("*").alias("n")).collect()
        assert {r.k: (r.m, r.n) for r in three} == {"hot": (3, 3), "b": (3, 3), None: (3, 3), "one": (1, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_search_equals_each_suggestion(spark):
    from cairn.operators import recall

    rng = random.Random(5)
    names = [" ".join(rng.choice(("Web", "Edge", "Zero-Trust", "KV", "Web/Mail", "Stream", "ab")) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    products = spark.createDataFrame([(f"p{k}-{rng.choice(('edge', 'web'))}", n) for k, n in enumerate(names)], "id string, name string")
    texts = ["web", "we", "KV", "ab", "edge", " Tru", "stre", "zero-", "", "p1-edge", "p1", "nothing", "mail"]
    got = recall.suggest_all(recall.search_index(products), products, spark.createDataFrame([(k, x) for k, x in enumerate(texts * 2)], "query int, text string")).collect()
    for k, x in enumerate(texts * 2):
        assert [r.id for r in sorted((r for r in got if r.query == k), key=lambda r: r.place)] == [r.id for r in recall.suggest(products, x).collect()], x


def test_sql_alone(spark, sf):
    from cairn.operators import recall
    from cairn.plans import learning_queries, sql_queries

    sql_queries._installed(spark, sf)
    row = spark.sql("SELECT collapse_ws(' a \n b ') AS t, round_cents(1.005) AS c, is_success(4, 5) AS s, is_success(0, 0) AS z, review_due(DATE '2024-01-01', 9) AS d").first()
    assert (row.t, row.s, row.z, str(row.d)) == ("a b", True, False, "2024-01-15")
    name = spark.sql("SELECT name FROM products ORDER BY id").first().name
    for text in (name[:4], name.lower(), "7", "", "zzz"):
        want = recall.suggest(learning_queries._products(spark, sf), text).select("id", "name").collect()
        assert spark.sql("SELECT * FROM suggest(:q)", args={"q": text}).collect() == want
    assert spark.sql("SELECT count(*) AS n FROM shared_products('1', '2')").first().n == spark.sql("SELECT count(DISTINCT a.id) AS n FROM members a JOIN members b ON a.id = b.id WHERE a.solution = '1' AND b.solution = '2'").first().n
    assert spark.sql("SELECT * FROM solutions_with('1')").count() == spark.sql("SELECT DISTINCT solution FROM members WHERE id = '1'").count()
    assert spark.table("tier_estimates").count() and spark.table("default_tiers").count() and spark.table("opened_cards").count() and spark.table("solution_boundaries").count() and spark.table("map_members").count()


def test_parsing_shuffles_nothing(spark, monkeypatch):
    """One table is written, of what pages say, and no element meets another by a shuffle."""
    plans, written = [], page_parsers.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(page_parsers, "written", seen)
    df = spark.createDataFrame([(1, f"https://{SITE}/overview", OVERVIEW)], "page_id int, url string, html string")
    parsed = page_parsers.parse(df)
    assert parsed.first().issue is None and len(plans) == 1
    assert not any("Exchange" in p for p in [*plans, parsed._jdf.queryExecution().executedPlan().toString()])


def test_plain_markup_as_the_reader_has_it():
    """What one expression reads, and what it leaves to Python's reader, give the same starts, ends and texts."""
    rng = random.Random(7)
    bits = ["<p>", "<P class=x>", "</p>", '<a href="/x?a=1&amp;b=2">', "</a >", "text", "&amp;", "&", "&lt", "a < b", "<!-- c -->", "<!doctype html>", "<br/>", "<img src=/a/b.png>", "<a href=x/>", "<b\n a='1' b>", "<title>", "</title>", "<script>", 'if (a<b) "</p>"', "</script>", "<x-y z=1>", "<!-- a--b -->", '<a b="1"c="2">', "<?pi?>", "</ p>", '<a b = "c">', "<", '<p data-x="a>b">', "<input disabled value=''>"]

    def events(read, html):
        out = []
        read(html, lambda tag, attrs: out.append((tag, [(n, v or "") for n, v in attrs])), lambda tag: out.append("/" + tag), lambda text: out.append([text]))
        joined = []
        for x in out:
            if isinstance(x, list) and joined and isinstance(joined[-1], list):
                x = [joined.pop()[0] + x[0]]
            joined.append(x)
        return joined

    def whole(html, start, end, data):
        reader = page_parsers._Reader(start, end, data)
        reader.feed(html)
        reader.close()

    for _ in range(5000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
        assert events(page_parsers._read, html) == events(whole, html), html


def test_elements_leave_python_in_small_batches(spark):
    """Six hundred pages of a hundred links each, in one batch: no more than a bounded number of elements is held at once."""
    import pyarrow as pa
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*StructType.fromDDL("page int").fields, StructField("elements", StructType.fromDDL(f"x array<struct<{page_parsers.ELEMENT}>>")["x"].dataType)])
    batch = pa.RecordBatch.from_pydict({"page": pa.array(range(600), pa.int32()), "html": ["<a href=/x>y</a>" * 100] * 600, "url": [f"https://{SITE}/"] * 600})
    got = list(page_parsers._batches(schema, 1)([batch]))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(600))
    assert max(len(b.column(1).values) for b in got) <= page_parsers.ELEMENTS_AT_ONCE + 100
