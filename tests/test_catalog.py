import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import assemble, claims, curated, curated_build, dimensions, integrity, learning, merge, places, pricing, progress, readmodels, recall, robots, scenario, source_config
from cairn.sources import json_documents, page_parsers, pages, progress_records
from cairn.streaming import progress as streaming


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string" if isinstance(value, str) else "v double").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [(0.4449, 0.44), (0.445, 0.45), (1.005, 1.0), (-2.5, -2.5)])
def test_round_cents(spark, value, want):
    assert one(spark, X.round_cents, value) == want


def test_text(spark):
    assert one(spark, X.collapse_whitespace, " a  b\n c ") == "a b c"
    assert one(spark, X.slugify, "Café & Crème!") == "cafe-creme"
    assert one(spark, X.slugify_ascii, "--") is None
    assert one(spark, lambda c: X.trim_summary(c, 12), "One two. Three four") == "One two."
    assert one(spark, lambda c: X.trim_summary(c, 6), "abcdefghij") == "abcdef"
    assert one(spark, X.utc_instant, "2026-01-02T03:04:05Z") and not one(spark, X.utc_instant, "2026-01-02T03:04:05+09:00")
    assert one(spark, X.utf16_length, "😀") == 2


def test_duplicates_and_report(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("a", 3)], "id string, ord int")
    assert sorted(r.ord for r in integrity.duplicate_keys(rows, ["id"], ["ord"]).collect()) == [2, 3]
    with pytest.raises(ValueError, match="2 issue.s.:\n  products.2..id: a\n"):
        integrity.gate(integrity.report([integrity.issues(integrity.duplicate_keys(rows, ["id"], ["ord"]), "duplicate-id", X.issue_path("products", F.col("ord"), "id"), F.col("id"), F.col("ord"))]))


def test_precedence(spark):
    claims = spark.createDataFrame([("k", "old", 0), ("k", "new", 2), ("k", None, 3), ("m", "x", 1), ("m", "y", 1), ("m", "z", 0)], "k string, v string, p int")
    assert {(r.k, r.v, r.n_values) for r in merge.pick(claims, "k", "v", "p").collect()} == {("k", "new", 1), ("m", "x", 2)}


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: cairn\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow:\nUser-agent: *\nDisallow: /\nCrawl-delay: 3")], "host string, body string")
    paths = spark.createDataFrame([("h", p) for p in ("/a", "/a/b", "/x.pdf", "/x.pdf?q", "/")], "host string, path string")
    got = {r.path: r.allowed for r in robots.decisions(paths, robots.parse(files), "cairn-bot").collect()}
    assert got == {"/a": False, "/a/b": True, "/x.pdf": False, "/x.pdf?q": True, "/": True}
    assert robots.crawl_delay(robots.parse(files), "other").first().delay == 3.0


def test_robots_lines_without_effect(spark):
    """Blank agents and delays that are no number change nothing; of repeated delays the last counts, of equally long
    tokens the first."""
    files = {
        "blank": "User-agent: *\nUser-agent:\nDisallow: /b\nDisallow /c",
        "delay": "User-agent: a\nCrawl-delay: soon\nUser-agent: cairn\nDisallow: /b\nCrawl-delay: 2\nCrawl-delay: 7",
        "tie": "User-agent: cai\nDisallow: /a\n\nUser-agent: irn\nDisallow: /b\nUser-agent: cai\nDisallow: /c",
        "before": "Disallow: /\nUser-agent: *\nDisallow: /a",
    }
    parsed = robots.parse(spark.createDataFrame(list(files.items()), "host string, body string"))
    paths = spark.createDataFrame([(h, p) for h in files for p in ("/a", "/b", "c")], "host string, path string")
    got = {(r.host, r.path) for r in robots.decisions(paths, parsed, "cairn").collect() if not r.allowed}
    assert got == {("blank", "/b"), ("delay", "/b"), ("tie", "/a"), ("tie", "c"), ("before", "/a")}
    assert [(r.host, r.delay) for r in robots.crawl_delay(parsed, "cairn").collect()] == [("delay", 7.0)]


def test_predicates_end_at_the_end(spark):
    for column, good in ((X.id_slug, "abc"), (X.utc_instant, "2026-01-02T03:04:05Z"), (lambda c: X.canonical_url(c, ["h"]), "https://h/x")):
        assert one(spark, column, good) and not one(spark, column, good + "\n")
    assert one(spark, lambda c: X.bounded_field(c, 3), "😀a") == "😀a" and one(spark, lambda c: X.bounded_field(c, 3), "😀😀") is None
    assert [one(spark, lambda c, n=n: X.trim_summary(c, n), "a😀😀b") for n in (1, 2, 3, 4, 6)] == ["a", "a", "a😀", "a😀", "a😀😀b"]
    words = spark.createDataFrame([("\uffff",), ("😀",), ("a",)], "v string")
    assert [r.v for r in words.orderBy(X.order_key(F.col("v"))).collect()] == ["a", "😀", "\uffff"]


def test_empty_layers_have_decoys(spark):
    products = spark.createDataFrame([(f"p{k}", f"P{k}") for k in range(6)], "id string, name string")
    placements = spark.createDataFrame([(f"p{k}", "l", "one") for k in range(5)] + [("ghost", "l", "one"), ("p5", "l", "three")], "id string, lane string, layer string")
    layers = dimensions.layers(spark, {"l": ["one", "two", "three"]})
    got = recall.recall_pool(products, placements, layers).where("NOT is_answer").collect()
    assert sorted((r.layer, r.id) for r in got) == [("two", "p0"), ("two", "p1")]


def test_picks(spark):
    answers = spark.createDataFrame([("x", "a"), ("x", "b")], "area string, id string")
    toggles = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("x", 3, "r"), ("x", 4, "p"), ("x", 5, "r"), ("x", 6, "s")], "area string, seq int, id string")
    assert sorted(r.id for r in recall.picks(toggles, answers).collect()) == ["q", "r"]
    rng, want, rows = random.Random(5), {}, []
    for n in range(400):
        key, i = (rng.choice(("u", "v", None, "w")), rng.choice(("x", "y", "none"))), rng.choice((*"abcdef", None))
        i = "a" if key[0] == "w" and i else i  # no more ids than there is room for
        rows.append((*key, n, i))
        held, room = want.setdefault(key, set()), {"x": 2, "y": 3, "none": 0}[key[1]]
        if i in held:
            held.remove(i)
        elif i and len(held) < room:
            held.add(i)
    rng.shuffle(rows)
    toggles = spark.createDataFrame(rows, "learner string, area string, seq int, id string").withColumn("room", F.lit(1))
    answers = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c")], "area string, id string")
    got = [tuple(r) for r in recall.picks(toggles, answers, ("learner", "area")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(*k, i) for k, ids in want.items() for i in ids}
    assert not recall.picks(toggles.limit(0), answers, ("learner", "area")).count()


def test_configuration(spark, tmp_path):
    def write(**over):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json_documents.serialize({"allowedHosts": ["s.org", "d.org"], "fetch": {"timeoutMs": 1000, "maxRetries": 2, "concurrency": 4, "minRequestIntervalMs": 250}, "sources": [{"id": "a", "url": "https://s.org/x", "pageKind": "marketing-product"}]} | over))
        return str(path)

    load = lambda path: source_config.load(spark, path, ["s.org", "d.org"], "d.org", "s.org")
    assert load(write()).count() == 1
    with pytest.raises(integrity.ValidationError) as e:
        load(write(allowedHosts=["s.org", "s.org", "evil.org"], fetch={"timeoutMs": 1000.5}, sources=[{"id": "A", "url": "http://s.org/x", "pageKind": "other"}]))
    assert [i.path for i in e.value.issues] == ["allowedHosts", "allowedHosts", "fetch.timeoutMs", "fetch.maxRetries", "fetch.concurrency", "fetch.minRequestIntervalMs", "sources[0].id", "sources[0].url", "sources[0].pageKind"]
    with pytest.raises(integrity.ValidationError) as e:
        load(write(sources=[{"id": "a", "url": "https://s.org", "pageKind": "developer-docs"}, {"id": "a", "url": "https://s.org/", "pageKind": "marketing-product"}, {"id": "b", "url": "https://x.org/", "pageKind": "marketing-product"}]))
    assert [(i.code, i.path) for i in e.value.issues] == [("duplicate-id", "sources[1].id"), ("invalid-shape", "sources[2].url"), ("invalid-shape", "sources[0].pageKind"), ("invalid-shape", "sources[1].url")]


def test_places(spark):
    rows = spark.createDataFrame([(f"k{random.Random(k).randrange(10**6)}", k) for k in range(500)], "name string, n int").repartition(7)
    got = {r.n: r.ord for r in places.placed(rows, ["name", "n"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [r.n for r in rows.orderBy("name", "n").collect()] and sorted(got.values()) == list(range(500))
    assert places.placed(rows.limit(0), ["name"]).count() == 0


def _pages_of_a_site(spark, over=()):
    """A small site: an overview, a product page, a solution page and a directory."""
    head = '<html><head><title>T</title><link rel="canonical" href="{}"><meta name="description" content="{}"></head><body>'
    sites = {
        "over": ("/products", "All", '<figure><figcaption>Fam One</figcaption><a href="/products/a"><div><strong>A</strong></div><p>Tag.</p></a><a href="/products/b/"><div><strong>B</strong></div></a></figure>'),
        "a": ("/products/a", "About A.", '<h1 data-cms-path="products.a.sections.hero.title">A</h1><p data-cms-path="products.a.sections.useCases.items.0.title">Use it</p><p data-cms-path="products.a.sections.useCases.items.0.description">D</p>'),
        "s": ("/solutions/s", "About S.", '<h1 data-cms-path="pages.s.hero.eyebrow">S</h1>'),
        "docs": ("/d", "Docs", '<main data-pagefind-body><a href="https://d.org/a/"><span>A</span><p>x</p></a><a href="https://d.org/a/more"><span>A</span><p>x</p></a><a href="https://x.org/b"><span>B</span><p>x</p></a></main>'),
    } | dict(over)
    kinds = {"over": "marketing-overview", "s": "marketing-solution", "docs": "developer-docs"}
    rows = [(k, f"https://x.org{path}", head.format(path, about) + body, kinds.get(k, "marketing-product")) for k, (path, about, body) in sites.items()]
    made = spark.createDataFrame(rows, "source string, url string, html string, page_kind string")
    parsed = page_parsers.parse(made, key="source", configured="page_kind")
    assert not parsed.where("issue IS NOT NULL").collect()
    return claims.normalized(parsed.join(made.select("source", "page_kind"), "source").withColumn("retrieved_at", F.lit("2026-01-01T00:00:00Z")), "d.org")


def test_assembly(spark, tmp_path):
    catalog = assemble.run(_pages_of_a_site(spark))
    rows = {c: sorted(tuple(r) for r in df.collect()) for c, df in catalog.items()}
    assert rows["products"] == [("a", "A", "About A.", "fam-one", ["a", "docs", "over"]), ("b", "B", 'Product "B" as listed on the official products overview.', "fam-one", ["over"])]
    assert rows["productFamilies"] == [("fam-one", "Fam One", 'Product family "Fam One" as grouped on the official products overview.', ["over"])]
    assert rows["solutions"] == [("s", "S", "About S.", ["s"])] and rows["useCases"] == [("use-it", "Use it", "D", ["a"])]
    path = str(tmp_path / "catalog.json")
    json_documents.write_catalog({c: df.withColumn("ord", F.monotonically_increasing_id()) for c, df in catalog.items() if c in ("solutions", "useCases")}, path, "2026-01-01T00:00:00Z")
    document = json_documents.read_document(spark, path)
    assert json_documents.collection(document, "solutions").first().name == "S" and json_documents.version_issues(document).isEmpty() and not json_documents.version_issues(document, "2").isEmpty()
    assert rows["relationships"] == [("product-use-case", "a", "use-it", ["a"])] and [r[0] for r in rows["sources"]] == ["a", "docs", "over", "s"]


def test_assembly_problems(spark):
    """A product that no overview lists, two pages that disagree, and a name without an id: all are named at once."""
    item = '<h1 data-cms-path="products.{0}.sections.hero.title">C</h1><p data-cms-path="products.{0}.sections.useCases.items.0.title">{1}</p><p data-cms-path="products.{0}.sections.useCases.items.0.description">{2}</p>'
    over = {"c": ("/products/c", "About C.", item.format("c", "Use it", "Other")), "c2": ("/products/c/", "About C?", item.format("c", "!!", "x"))}
    with pytest.raises(assemble.RunError) as e:
        assemble.run(_pages_of_a_site(spark, over))
    found = {(p.subject, p.message) for p in e.value.problems}
    assert ("product c", "incomplete: https://x.org/products/c") in found
    assert ("product /products/c", "conflicting summary between https://x.org/products/c and https://x.org/products/c/") in found
    assert ("use case use-it", "conflicting summary between https://x.org/products/a and https://x.org/products/c") in found
    assert ("https://x.org/products/c/", "no id from the name of card !!") in found
    assert ("product-use-case c use-it", "unknown products id c") in found


def test_configured_kind(spark):
    html = '<html><head><title>T</title><link rel=canonical href="/n"><meta name=description content=x></head><body><h1 data-cms-path="pages.n.hero.eyebrow">N</h1>'
    rows = [(1, "https://x.org/n", html, "marketing-solution"), (2, "https://x.org/n", html, "developer-docs"), (3, "https://x.org/n", html, None)]
    got = {r.page_id: r.issue for r in page_parsers.parse(spark.createDataFrame(rows, "page_id int, url string, html string, kind string"), configured="kind").collect()}
    assert got == {1: None, 2: "not the configured kind", 3: None}


def test_curated_shapes_of_lists(spark):
    tail = ("https://h.example/x", "2026-01-02T03:04:05Z")
    rows = {
        "compositions": ("solutionId string, productIds array<string>", [("s", ["a", "b"]), ("s", []), ("S!", ["a", "a"])], {"compositions[1].productIds", "compositions[2].solutionId", "compositions[2].productIds"}),
        "scenarios": ("id string, titleKo string, situationKo string, productIds array<string>, talkTrackKo string", [("x", "t", "s", ["a", "b"], None), ("x", " ", "s", ["a"], "")], {"scenarios[1].titleKo", "scenarios[1].productIds", "scenarios[1].talkTrackKo"}),
        "narration": ("productId string, captionKo string", [("a", "c"), ("a", None)], {"narration[1].captionKo"}),
        "solutionNotes": ("solutionId string, oneLinerKo string, whyKo string, misconceptionKo string, customerQuestionKo string, boundariesKo array<struct<solutionId string, noteKo string>>, seAngleKo string, aeAngleKo string",
                          [("s", "o", "w", "m", "c", None, None, None), ("s", "o", "w", "m", "c", [("T", "n"), ("t", "")], None, "x")], {"solutionNotes[1].boundariesKo[0].solutionId", "solutionNotes[1].boundariesKo[1].noteKo"}),
    }
    for name, (schema, items, want) in rows.items():
        df = spark.createDataFrame([(k, *r, *tail) for k, r in enumerate(items)], f"ord int, {schema}, sourceUrl string, verifiedAt string")
        assert {r.path for r in curated.shape_issues(df, name, ["h.example"], {}).collect()} == want


def test_curated_build(spark):
    notes = spark.createDataFrame([("b", [("z", "1"), ("a", "2"), ("a", "3")]), ("a", None)], "solutionId string, boundariesKo array<struct<solutionId string, noteKo string>>")
    narration = spark.createDataFrame([(0, "z", "c"), (1, "a", "d")], "ord int, productId string, captionKo string")
    built = curated_build.artifact({"solutionNotes": notes, "narration": narration}, notes.select(F.lit("x").alias("path"), F.lit("m").alias("message"), F.lit(0).alias("ord")).limit(0), notes.select(F.lit("x").alias("path"), F.lit("m").alias("message"), F.lit(0).alias("ord")).limit(0))
    assert [(r.ord, r.solutionId, [b.noteKo for b in r.boundariesKo or []]) for r in built["solutionNotes"].orderBy("ord").collect()] == [(0, "a", []), (1, "b", ["2", "3", "1"])]
    assert [r.productId for r in built["narration"].orderBy("ord").collect()] == ["z", "a"]


def test_stop_index(spark):
    got = [one(spark, lambda c: learning.stop_index(c, F.lit(3)), x) for x in ("2", " 3 ", "0", "4", "1.5", "x", "")]
    assert got == [2, 3, 1, 1, 1, 1, 1] and one(spark, lambda c: learning.stop_index(c, F.lit(0)), "1") == 0


def test_pricing(spark):
    tiers = spark.createDataFrame([("p", "paid", 1, 5.0), ("p", "ent", 2, None)], "product string, tier string, pos int, monthly double")
    meters = spark.createDataFrame([("p", "paid", 1, "req", "Requests", 10.0, 1, 0.3)], "product string, tier string, mpos int, metric string, label string, included double, per_units int, usd double")
    for amount, want in ((10.0, 5.0), (11.5, 5.45), (-3.0, 5.0)):
        usage = spark.createDataFrame([("p", "req", amount)], "product string, metric string, amount double")
        assert {r.tier: r.total for r in pricing.tier_estimates(tiers, meters, usage).collect()} == {"paid": want, "ent": None}


def test_suggest(spark):
    items = spark.createDataFrame([("r2", "Object Store"), ("kv", "Key-Value"), ("d1", "Data One")], "id string, name string")
    assert [r.id for r in recall.suggest(items, "r2").collect()] == ["r2"]
    assert [r.id for r in recall.suggest(items, "val").collect()] == ["kv"]
    assert recall.suggest(items, "alue").count() == 0


def _events(n=300):
    rng = random.Random(3)
    kinds = ["visit", "mark", "practice-hit", "practice-miss", "verify-hit", "verify-miss"]
    return [(f"n{rng.randrange(12)}", k, rng.choice(kinds)) for k in range(n)]


def _folded(rows):
    state = {}
    for node, _, kind in sorted(rows, key=lambda r: r[1]):
        state[node] = streaming.step(*state.get(node, (0, 0)), kind)
    return {k: (progress.STATUS[r], s) for k, (r, s) in state.items()}


def test_node_states_equal_fold(spark):
    rows = _events()
    got = {r.node: (r.status, r.streak) for r in progress.node_states(spark.createDataFrame(rows, "node string, ord long, kind string"), ["node"], ["ord"]).collect()}
    assert got == _folded(rows)


def test_streaming_equals_fold(spark, tmp_path):
    rows = _events()
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], "node string, ord long, kind string").coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("node string, ord long, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    query = progress_records.keep(streaming.node_states(stream), str(tmp_path / "states"), str(tmp_path / "c"))
    assert query.awaitTermination(120)
    want, n = _folded(rows), len(list((tmp_path / "states").iterdir()))
    got = {r.node: (r.status, r.streak) for r in progress_records.kept(spark, str(tmp_path / "states"), "node").collect()}
    assert n == 3 and got == want


def test_documents(spark, tmp_path):
    path = tmp_path / "c.json"
    json_documents.write_atomically(json_documents.serialize({"schemaVersion": "1", "odd": 1, "products": [{"id": "a", "name": "A"}]}), str(path))
    doc = json_documents.read_document(spark, str(path))
    assert json_documents.collection(doc, "products").first().id == "a"
    texts = json_documents.read_texts(spark, str(path))
    assert [(r.path, r.message) for r in json_documents.unknown_keys(texts).collect()] == [("odd", 'Unrecognized key: "odd"')]
    assert not json_documents.is_empty(doc).first().empty


def test_document_lifecycle(spark, tmp_path):
    """Missing, broken, unsound, empty and sound documents; unknown keys at any depth."""
    none = lambda doc: doc.select(F.lit(1).alias("x")).limit(0)
    some = lambda doc: doc.select(F.lit(1).alias("x"))
    def status(body, check=none, schema=json_documents.CATALOG, collections=json_documents.COLLECTIONS):
        path = tmp_path / f"{abs(hash((body, check)))}.json"
        path.write_text(body)
        return json_documents.load(spark, str(path), schema, check, collections)[0]

    assert json_documents.load(spark, str(tmp_path / "none.json"), json_documents.CATALOG, none, json_documents.COLLECTIONS) == ("fetch-error", None)
    assert status("{nope") == "invalid-data" and status('{"products":[{"id":"a","x":{"y":1}}]}') == "invalid-data"
    assert status('{"schemaVersion":"1","products":[]}') == "empty" and status('{"products":[{"id":"a"}]}') == "success" and status('{"products":[{"id":"a"}]}', some) == "invalid-data"
    assert status('{"narration":[{"productId":"a","captionKo":"x"}]}', none, json_documents.CURATED, ("narration",)) == "success"
    rows = spark.createDataFrame([('{"pricing":[{"productId":"a","tiers":[{"id":"t","meters":[{"overage":{"usd":1,"eur":2}}]},{"odd":1}]}],"x":null}',), (None,), ("[1]",)], "text string")
    assert sorted(r.path for r in json_documents.unknown_keys(rows, json_documents.CURATED).collect()) == ["pricing[0].tiers[0].meters[0].overage.eur", "pricing[0].tiers[1].odd", "x"]


def test_redirects(spark):
    asked = spark.createDataFrame([("https://h/a",), ("https://h/b",), ("https://h/loop",)], "url string")
    answers = spark.createDataFrame([("https://h/a", 301, "https://h/c"), ("https://h/c", 404, None), ("https://h/b", 302, "https://evil/x"), ("https://h/loop", 302, "https://h/loop")], "url string, status int, location string")
    got = {r.url: (r.status, r.hops, r.problem) for r in pages.follow(asked, answers, ["h"]).collect()}
    asked = spark.createDataFrame([("https://h:443/a/b",)], "url string")
    answers = spark.createDataFrame([("https://h/a/b", 307, "../c?x=1"), ("https://h/c?x=1", 302, "/d"), ("https://h:443/d", 301, "//h/e"), ("https://h/e", 200, None)], "url string, status int, location string")
    assert [tuple(r)[1:] for r in pages.follow(asked, answers, ["h"]).collect()] == [("https://h/e", 200, 3, None)]
    assert [tuple(r)[1:] for r in pages.follow(asked, answers, ["h"], lambda u: ~u.endswith("/d")).collect()] == [("https://h/d", 302, 2, "vetoed")]
    assert got["https://h/a"] == (404, 1, None) and got["https://h/b"][2] == "forbidden" and got["https://h/loop"][2] == "too-many-redirects"


def test_curated_pricing_shape(spark):
    meters = "meters array<struct<metric string, included double, per string, labelKo string, overage struct<usd double, perUnits double>>>"
    schema = f"ord int, productId string, tiers array<struct<id string, name string, monthlyUsd double, noteKo string, featuresKo array<string>, limits array<struct<metric string, included double, per string, labelKo string, noteKo string>>, {meters}>>, sourceUrl string, verifiedAt string"
    good = ("paid", "Paid", 5.0, None, ["a"], [("qty", 1.0, "day", None, None)], [("qty", 0.0, "month", None, (0.3, 10.0))])
    free = ("free", "Free", None, None, None, None, None)
    bad = ("free", " ", -1.0, None, [], [("qty", 0.0, "year", None, None)], [("qty", 0.0, "month", None, (0.0, 1.5)), ("qty", 0.0, "month", None, None)])
    rows = spark.createDataFrame([(0, "p", [free, good], "https://h.example/x", "2026-01-02T03:04:05Z"), (1, "p", [free, bad], "https://h.example/x", "2026-01-02T03:04:05Z"), (2, None, None, None, None)], schema)
    found = curated.shape_issues(rows, "pricing", ["h.example"], {}).collect()
    at = "pricing[1].tiers[1]"
    assert {r.path for r in found if r.ord == 1} == {"pricing[1].tiers", *(f"{at}.{x}" for x in ("name", "monthlyUsd", "featuresKo", "limits[0].included", "limits[0].per", "meters[0].overage.usd", "meters[0].overage.perUnits", "meters[1].overage.usd", "meters[1].overage.perUnits"))}
    assert sorted(r.path for r in found if r.ord != 1) == ["pricing[2].productId", "pricing[2].sourceUrl", "pricing[2].tiers", "pricing[2].verifiedAt"]


def test_curated_note_shape(spark):
    schema = "ord int, productId string, whyKo string, misconceptionKo string, customerQuestionKo string, analogyKo string, se struct<archKo string, opsKo string, limitsKo string>, ae struct<pitchKo string, valueKo string, objections array<struct<q string, a string>>>, battlecard array<struct<competitor string, vsKo string, grounding string, sourceUrl string>>, sourceUrl string, verifiedAt string"
    tail = ("https://h.example/x", "2026-01-02T03:04:05Z")
    rows = [(0, "p", "w", "m", "c", None, None, None, None, *tail), (1, "p", "w", "m", "c", "", (None, None, None), ("x", None, [("q", "a")] * 4), [("c", "v", "rumour", tail[0])], *tail)]
    found = curated.shape_issues(spark.createDataFrame(rows, schema), "learningNotes", ["h.example"], {}).collect()
    assert sorted(r.path for r in found) == [f"learningNotes[1].{x}" for x in ("ae.objections", "analogyKo", "battlecard[0].grounding", "se")]


def test_scenario_drops_what_is_unknown(spark):
    tiers = spark.createDataFrame([("a", "free"), ("a", "paid"), ("b", "free")], "product string, tier string")
    metrics = spark.createDataFrame([("a", "m"), ("b", "m")], "product string, metric string")
    urls = [("k", "https://x.example/c?products=b,%20a,zz,b&t.a=paid&t.b=gold&u.a.m=2.5&u.b.m=NaN&u.c.m=4&u.a.other=3&u.b.m=7#f"), ("n", None), ("e", ""), ("z", "products=zz")]
    found = scenario.settings(spark.createDataFrame(urls, "k string, q string"), "k", "q", tiers, metrics)
    assert [(r.k, r["product"], r.tier, r.usage) for r in found.orderBy("pos").collect()] == [("k", "b", None, {}), ("k", "a", "paid", {"m": 2.5})]
    assert [r["query"] for r in scenario.serialize(found, "k").collect()] == ["products=b,a&t.a=paid&u.a.m=2.5"]


def test_page_parsers(spark):
    head = '<html><head><title> A  page </title><link rel="canonical" href="{}"><meta name="description" content="About it."></head><body>'
    entry = "<main data-pagefind-body>{}</main>"
    sites = {
        1: ("products/", "/products", '<figure><figcaption>Fam <b>One</b></figcaption><a href="/products/a"><div><strong>A &amp; B</strong></div><p>Tag line.</p></a><a href="/products/b/"><span><strong>B</strong></span></a></figure>'),
        2: ("solutions", "https://X.org/solutions/", '<div><a aria-label="See solution about S" href="s1"></a><div><p data-cms-path="pages.solutions-page.benefits.0.title"><strong>S</strong></p><p data-cms-path="pages.solutions-page.benefits.0.description">Desc<script>x</script>.</p></div></div>'),
        3: ("m", "/m", '<h1 data-cms-path="products.m.sections.hero.title">M</h1><p data-cms-path="products.m.sections.useCases.items.0.title">T<p data-cms-path="products.m.sections.useCases.items.0.description">D</p>'),
        4: ("n", "/n", '<h1 data-cms-path="pages.n.hero.eyebrow"> N  n</h1>'),
        5: ("d", "/d", entry.format('<a href="/nav">nav</a><a href="/d/e?q=1"><span>E</span><p>About E</p></a>')),
        6: ("d", "/other", entry.format('<a href="/d/e"><span>E</span><p>About E</p></a>')),
        7: ("d", "/d", entry.format('<a href="/d/e"><span>E</span></a>')),
        8: ("d", "/d", entry.format('<a href="/d/e"><p>E</p></a>') + '<h1 data-cms-path="pages.n.hero.eyebrow">N</h1>'),
    }
    rows = [(k, f"https://x.org/{path}", head.format(link) + body, "x") for k, (path, link, body) in sites.items()] + [(9, None, None, None), (10, "https://x.org/", "", "x")]
    parsed = page_parsers.parse(spark.createDataFrame(rows, "page_id int, url string, html string, kind string").repartition(1))
    found = {r.page_id: r for r in parsed.collect()}
    assert [found[k].kind for k in range(1, 6)] == list(page_parsers.KINDS) and not any(found[k].issue for k in range(1, 6))
    assert {k: [tuple(c) for c in found[k].cards] for k in range(1, 6)} == {
        1: [("Fam One", "A & B", "Tag line.", "https://x.org/products/a"), ("Fam One", "B", None, "https://x.org/products/b/")],
        2: [(None, "S", "Desc.", "https://x.org/solutions/s1")],
        3: [(None, "T", "D", None)],
        4: [],
        5: [(None, "E", "About E", "https://x.org/d/e?q=1")],
    }
    assert found[4].solution_name == "N n" and found[1].title == "A page" and found[1].canonical_url == "https://x.org/products"
    assert [found[k].issue for k in range(6, 11)] == ["canonical link of another page", "card without a description", "several of the kinds fit", "none of the kinds fit", "none of the kinds fit"]
    assert all(found[k].cards is None for k in range(6, 11))


def test_map_members(spark):
    """Members as rows, in buckets far smaller than a (lane, layer); names repeat, differ in case, are null or empty."""
    rng = random.Random(8)
    names = [rng.choice([None, "", "Same", "same", f"N{rng.randrange(400)}", f"n{rng.randrange(400)}"]) for _ in range(2000)]
    products = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    placed = [(k, rng.choice("ab"), rng.choice("xz")) for k in range(2000) for _ in range(3)] + [(5000, "a", "x"), (1, None, "x")]
    placements = spark.createDataFrame(placed, "id long, lane string, layer string")
    layers = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "x", 2)], "lane string, layer string, ord int")
    want = {}
    for lane, layer in (("a", "x"), ("a", "y"), ("b", "x")):
        ids = {k for k, la, ly in placed if (la, ly) == (lane, layer) and k < 2000}
        want[lane, layer] = sorted(ids, key=lambda k: (names[k] is None, (names[k] or "").lower(), k))
    got = {key: [] for key in want}
    for r in readmodels.map_members(products, placements, layers).orderBy("place").collect():
        got[r.lane, r.layer].append(r.id)
        assert r.place == len(got[r.lane, r.layer]) and r.name == names[r.id]
    assert got == want
    model = {(r.lane, r.layer): (r.n_products, r.members) for r in readmodels.map_model(products, placements, layers).collect()}
    assert model == {key: (len(ids), " | ".join(names[k] for k in ids if names[k] is not None)) for key, ids in want.items()}
    largest = readmodels._ranged_members(products, placements, layers).groupBy("lane", "layer", "bucket").count().agg(F.max("count")).first()[0]
    assert largest < 0.5 * len(want["a", "x"])


def _exchanged(df) -> tuple[list, str]:
    """The rows, collected, and the plan as it ran."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_later_rows_travel_once(spark, monkeypatch):
    """Rows meet no second copy of themselves, unless a key is in very many of them; ties and nulls are as they were either way."""
    rows = [(k % 7 if k % 11 else None, f"x{k % 3}", k // 2 if k % 13 else None) for k in range(400)] + [(99, "one", k) for k in range(50)] + [(99, "one", 0)] * 2
    want, seen = [], set()
    for r in sorted((r for r in rows if None not in r), key=lambda r: r[2]):
        want += [r] if r[:2] in seen else []
        seen.add(r[:2])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows, "a int, b string, ord int").repartition(3)
        got, plan = _exchanged(integrity.later_rows(df, ["a", "b"]))
        assert sorted(map(tuple, got)) == sorted(want)
        assert "SortMergeJoin" not in plan.split("== Initial Plan ==")[0]
        for most in (0, 30):
            monkeypatch.setattr(integrity, "CROWDED", most)
            assert sorted(map(tuple, integrity.later_rows(df, ["a", "b"]).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ends_of_edges_are_looked_up_once_an_id(spark, monkeypatch):
    """Edges don't travel to be looked up: what is exchanged by id is a row for each id and task. Issues are the same beyond the limit of a broadcast."""
    text = "ord long, id string, sourceIds array<string>"
    made = {c: spark.createDataFrame([(0, f"{c}-0", ["s"])], text) for c in ("productFamilies", "solutions", "useCases")}
    made["sources"] = spark.createDataFrame([(0, "s")], "ord long, id string")
    made["products"] = spark.createDataFrame([(0, "p", ["s"], "productFamilies-0"), (1, "q", ["s"], None)], text + ", familyId string")
    edge = lambda k: (k, "product-solution", f"p{k % 2 or ''}", "solutions-0" if k % 3 else "none", ["s"])
    made["relationships"] = spark.createDataFrame([edge(k) for k in range(600)], "ord long, type string, fromId string, toId string, sourceIds array<string>").coalesce(1)
    want = sorted([(k, 0, f"Unknown products id 'p{k % 2}'") for k in range(600) if k % 2] + [(k, 1, "Unknown solutions id 'none'") for k in range(600) if k % 3 == 0])
    unknown = lambda: integrity.document_issues(made).where("code = 'unknown-entity-reference'")
    found, plan = _exchanged(unknown().select("ord", "sub", "message"))
    assert sorted(map(tuple, found)) == want
    assert "LeftAnti" not in plan.split("== Initial Plan ==")[0]
    monkeypatch.setattr(integrity, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, unknown().select("ord", "sub", "message").collect())) == want


def test_integrity_is_not_asked_of_rows_of_wrong_shape(spark):
    shape = spark.createDataFrame([("invalid-shape", "a", "m", 1, 0)], "code string, path string, message string, ord long, phase int")
    more = spark.createDataFrame([("duplicate-id", "b", "n", 2, 3, 0)], "code string, path string, message string, ord long, sub long, phase int")

    def never():
        raise AssertionError("asked")

    assert integrity.two_phases(shape, never).select("path", "sub").collect() == [("a", None)]
    for later in (more, lambda: more):
        assert [(r.path, r.sub, r.phase) for r in integrity.two_phases(shape.where("ord > 1"), later).collect()] == [("b", 3, 0)]
