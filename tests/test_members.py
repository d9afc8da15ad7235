import random
import re

from pyspark.sql import functions as F

from cairn.operators import learning, readmodels, recall, robots
from cairn.operators.member_sets import WORD, WORDS, Sets


def test_common_members(spark):
    """Against sets in memory: a hub, sets over many blocks, an empty one, repeated rows, nulls, a set and itself, both ways."""
    rng = random.Random(3)
    sets = {f"s{k}": {f"p{rng.randrange(200 if k % 2 else 20_000)}" for _ in range(rng.choice((1, 30, 400)))} for k in range(30)}
    sets |= {"hub": {f"p{k}" for k in range(3 * WORD * WORDS)}, "twin": {f"p{k}" for k in range(2 * WORD * WORDS)}, "own": {"only"}}
    rows = [(s, i) for s, ids in sets.items() for i in ids]
    rows += rows[:500] + [(None, "p1"), ("s1", None), (None, None)]
    keys = [*sets, "ghost"]
    pairs = [("hub", k) for k in keys] + [(rng.choice(keys), rng.choice(keys)) for _ in range(60)] + [("s1", "s3"), ("s3", "s1"), ("own", "own"), (None, "s1"), ("s1", None)]
    pairs += pairs[:5]
    got = Sets(spark.createDataFrame(rows, "solution string, id string").withColumn("a", F.lit(0)))
    asked = spark.createDataFrame(pairs, "a string, b string").withColumn("id", F.lit(1))
    want = {(a, b): sets.get(a, set()) & sets.get(b, set()) for a, b in pairs if a and b}
    counts = got.counts(asked).collect()
    assert len(counts) == len({(r.a, r.b) for r in counts}) and {(r.a, r.b): r.n_common for r in counts} == {k: len(v) for k, v in want.items() if v}
    ids = [tuple(r) for r in got.ids(asked).collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {(*sorted(k), i) for k, v in want.items() for i in v}
    empty = Sets(spark.createDataFrame([], "solution string, id string"))
    assert not empty.counts(asked).count() and not empty.ids(asked).count()


def test_boundaries_as_rows(spark):
    members = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "ghost"), ("b", "y"), ("b", "ghost"), ("c", "z")], "solution string, id string")
    products = spark.createDataFrame([("x", "X"), ("y", "Y"), ("z", "Z")], "id string, name string")
    solutions = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    bounds = spark.createDataFrame([("a", "b", "ab"), ("c", "a", "ca"), ("a", "a", "self"), ("b", "q", "bq")], "a string, b string, note string")
    rows = learning.card_boundaries(solutions, members, products, bounds).collect()
    assert {(r.solution, r.neighbour, r.neighbour_name, r.note, tuple(c["id"] for c in r.shared)) for r in rows} == {
        ("a", "b", "B", "ab", ("ghost", "y")), ("b", "a", "A", "ab", ("ghost", "y")), ("a", "c", "C", "ca", ()), ("c", "a", "A", "ca", ()), ("b", "q", "q", "bq", ()),
    }
    overlap = {(r.a, r.b): r.n_common for r in readmodels.boundary_overlap(bounds, members).collect()}
    assert overlap[("a", "a")] == 3 and overlap[("a", "b")] == overlap[("b", "a")] == 2 and overlap[("q", "b")] == 0
    asked = recall.solution_pools(solutions, members, products, bounds)[1].collect()
    assert {(r.solution, r.neighbour) for r in asked} == {("a", "b"), ("b", "a")}


def test_longest_rule_against_all(spark):
    """Against every rule of the host in turn: rules that begin with a wildcard, short and long runs, end marks, ties."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab/.") for _ in range(rng.randint(0, n)))
    made = sorted({"/" * rng.randint(0, 1) + "*".join(word(5) for _ in range(rng.randint(1, 4))) + rng.choice(("", "$")) for _ in range(150)} - {"", "$"})
    lines = [(rng.choice(("allow", "disallow")), p if p[0] in "/*" else "/" + p) for p in made]
    parsed = robots.parse(spark.createDataFrame([("h", "user-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in lines)), ("other", "user-agent: *\ndisallow: /")], "host string, body string"))
    asked = sorted({"/" + word(9) for _ in range(300)} | {"/", ""})

    def holds(pattern: str, path: str) -> bool:
        end = pattern.endswith("$")
        return re.match(".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + (r"\Z" if end else ""), path, re.S) is not None

    got = {r.path: r.allowed for r in robots.decisions(spark.createDataFrame([("h", p) for p in asked], "host string, path string"), parsed, "cairn").collect()}
    for path in asked:
        full = path if path.startswith("/") else "/" + path
        fits = [(len(p), k == "allow") for k, p in lines if holds(p, full)]
        assert got[path] == (max(fits)[1] if fits else True), path
    assert len(set(got.values())) == 2


def test_what_no_set_that_stays_has_doesnt_travel(spark, monkeypatch):
    """A hub of two thousand ids and two hundred sets with ten of them each and three hundred others: only the tens are written."""
    from cairn.operators import member_sets

    size, written = [], member_sets.written

    def seen(df):
        out = written(df)
        size.append(out.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return out

    monkeypatch.setattr(member_sets, "written", seen)
    rows = [("hub", f"h{k}") for k in range(2000)] + [(f"s{k}", f"h{10 * k + j}") for k in range(200) for j in range(10)]
    rows += [(f"s{k}", f"x{300 * (k // 2) + j}") for k in range(200) for j in range(300)]
    counts = Sets(spark.createDataFrame(rows, "solution string, id string")).counts(spark.createDataFrame([("hub", f"s{k}") for k in range(200)], "a string, b string"))
    assert {r.n_common for r in counts.collect()} == {10} and counts.count() == 200
    assert sum(size) < 200_000


def test_answers_alone_need_no_pairs(spark, sf, monkeypatch):
    from cairn.operators import learning as cards
    from cairn.plans import learning_queries

    monkeypatch.setattr(cards, "Sets", None)  # pairs would be looked up by it
    assert learning_queries.solution_pool_answers(spark, sf).columns == ["solution", "id", "name"]


def test_products_of_cards_are_made_alone(spark, sf, monkeypatch):
    """What a query leaves out is not made; cards have the same products with and without their boundaries."""
    from cairn import plans

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    solutions, notes = table([("s", "S"), ("t", "T"), ("u", "U")], "id string, name string"), table([("s", "n")], "id string, note string")
    members = table([("s", "2"), ("s", "1"), ("s", "2"), ("s", "9"), ("t", "2"), ("x", "1"), ("t", None)], "solution string, id string")
    products, bounds = table([("1", "beta"), ("2", "Alpha")], "id string, name string"), table([("s", "t", "w")], "a string, b string, note string")
    cards = learning.solution_cards(solutions, notes, members, products, bounds)
    want = {("s", "n", (("9", "9"), ("2", "Alpha"), ("1", "beta"))), ("t", None, ((None, None), ("2", "Alpha"))), ("u", None, None)}
    asked = lambda df: {(r.id, r.note, tuple(map(tuple, r.products)) if r.products is not None else None) for r in df.collect()}
    assert asked(cards) == want and cards.columns == ["id", "name", "note", "products", "boundaries"]
    assert {r.id: [b.shared for b in r.boundaries or []] for r in cards.collect()} == {"s": [[("2", "Alpha")]], "t": [[("2", "Alpha")]], "u": []}

    def never(*_):
        raise AssertionError("asked")

    monkeypatch.setattr(learning, "card_boundaries", never)
    assert asked(learning.card_products(solutions, notes, members, products)) == want
    assert plans.queries()["solution_card_products"](spark, sf).count()
