"""The rules of relational plans that ordinary SQL has otherwise: nulls, empty folds, coverage, refusals."""

import pytest

from quern.plans.coverage import EXHAUSTIVE, Coverage, incomplete
from quern.plans.relational import Assertion, Bound, Compiled, Expand, Filter, Fold, Group, Join, Plan, Project, Source, Test, selected_in_winning_tier
from quern.schema import PlanError

Test.__test__ = False
ROWS = [("a1", "s1", 0, "x", True), ("a2", "s1", 1, None, None), ("a3", "s1", 2, "y", False), ("b1", "s2", 0, None, True), ("c1", None, 5, "x", True)]


@pytest.fixture(scope="module")
def args(spark):
    return spark.createDataFrame(ROWS, "id string, site string, n long, name string, spread boolean")


def compiled(args, *relations, coverage=EXHAUSTIVE, assertions=(), **more):
    return Compiled(Plan((Source("a", "a"), *relations), assertions), {"a": Bound(args, coverage)} | more)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_comparisons_never_hold_for_null(args):
    for op in ("eq", "ne"):
        assert not {"a2", "b1"} & set(ids(compiled(args, Filter("f", "a", (Test("name", op, "x"),))).rows("f")))
    assert ids(compiled(args, Filter("f", "a", (Test("name", "is_null"),))).rows("f")) == ["a2", "b1"]
    assert ids(compiled(args, Filter("f", "a", (Test("name", "in", ("x", "z")), Test("n", "ge", 1)))).rows("f")) == ["c1"]


def test_joins_match_null_to_null(spark, args):
    sites = spark.createDataFrame([("s1", 1), (None, 2), (None, 3)], "k string, v int")
    c = compiled(args, Source("s", "s"), Join("i", "inner", "a", "s", (("site", "k"),)), Join("m", "semi", "a", "s", (("site", "k"),)), Join("t", "anti", "a", "s", (("site", "k"),)), s=Bound(sites))
    assert ids(c.rows("i")) == ["a1", "a2", "a3", "c1", "c1"]
    assert ids(c.rows("m")) == ["a1", "a2", "a3", "c1"]
    assert ids(c.rows("t")) == ["b1"]


def test_folds(args):
    none = (Test("n", "gt", 100),)
    folds = {"n_": Fold("count"), "names": Fold("count_distinct", "name"), "low": Fold("min", "n"), "no": Fold("max", "n", none), "some": Fold("any", "spread"), "every": Fold("all", "spread"), "no_any": Fold("any", "spread", none), "no_all": Fold("all", "spread", none)}
    got = {r.site: r.asDict() for r in compiled(args, Group("g", "a", ("site",), folds)).rows("g").collect()}
    assert got["s1"] | {} == {"site": "s1", "n_": 3, "names": 2, "low": 0, "no": 0, "some": 1, "every": 0, "no_any": 0, "no_all": 1}
    assert got[None]["n_"] == 1 and got["s2"]["every"] == 1


def test_ordered_equal(spark):
    rows = [("same", 0, "a", "a"), ("same", 1, "b", "b"), ("swapped", 0, "a", "b"), ("swapped", 1, "b", "a"), ("twice", 0, "a", "a"), ("twice", 0, "b", "b"), ("null", None, "a", "a")]
    df = spark.createDataFrame(rows, "g string, p long, x string, y string")
    c = compiled(df, Group("g", "a", ("g",), {"same": Fold("ordered_equal", sides=(("p", "x"), ("p", "y")))}))
    assert {r.g: r.same for r in c.rows("g").collect()} == {"same": 1, "swapped": 0, "twice": 0, "null": 0}


def test_coverage_decides_between_violation_and_obligation(args):
    most, least, exactly = Assertion("g", "k", "at_most", 2), Assertion("g", "k", "at_least", 2), Assertion("g", "k", "exactly", 2)
    group = Group("g", "a", ("site",), {"k": Fold("count")}, ("id",))
    sizes = {r.site: r.k for r in compiled(args, group).rows("g").collect()}
    assert max(sizes.values()) > 2 and min(sizes.values()) <= 2
    # An exceeded upper bound is proven by the rows read; one that is kept says that there are no others.
    for level in (EXHAUSTIVE, Coverage("proven_subset"), incomplete("cut")):
        for assertion in (most, exactly):
            c = compiled(args, group, coverage=level, assertions=(assertion,))
            got = {r.site: r.verdict for r in c.violations(assertion).collect()}
            kept = {} if level.complete else {s: "obligation" for s, k in sizes.items() if k <= 2}
            under = {s: "violation" for s, k in sizes.items() if k < 2} if level.complete and assertion is exactly else {}
            assert got == kept | under | {s: "violation" for s, k in sizes.items() if k > 2} and c.clean(assertion) is False
    part = compiled(args, group, coverage=Coverage("proven_subset"), assertions=(least,))
    assert {r.site for r in part.violations(least).collect()} == {s for s, k in sizes.items() if k < 2}
    assert {(r.verdict, r.reason) for r in part.violations(least).collect()} <= {("obligation", "absence_requires_exhaustive_coverage")}
    shown = compiled(args, group, assertions=(most,)).violations(most).head()
    assert [r.id for r in shown.representatives] == ["a1", "a2", "a3"]


def test_no_group_over_partial_rows_is_an_obligation(args):
    zero = Assertion("g", "k", "exactly", 0)
    relations = (Filter("none", "a", (Test("site", "eq", "no such site"),)), Group("g", "none", ("site",), {"k": Fold("count")}))
    assert compiled(args, *relations, assertions=(zero,)).violations(zero).count() == 0
    c = compiled(args, *relations, coverage=Coverage("proven_subset"), assertions=(zero,))
    assert [(r.site, r.verdict) for r in c.violations(zero).collect()] == [(None, "obligation")] and c.clean(zero) is None


def test_anti_over_partial_rows_proves_nothing(spark, args):
    zero = Assertion("g", "k", "exactly", 0)
    other = spark.createDataFrame([("s1",)], "k string")
    relations = (Source("s", "s"), Join("t", "anti", "a", "s", (("site", "k"),)), Group("g", "t", ("site",), {"k": Fold("count")}))
    for level, want in ((EXHAUSTIVE, {"violation"}), (Coverage("proven_subset"), {"obligation"})):
        c = compiled(args, *relations, assertions=(zero,), s=Bound(other, level))
        assert {r.verdict for r in c.violations(zero).collect()} == want and c.bound["g"].witnessed == level.complete


def test_meet_and_anti_over_partial(spark, args):
    assert incomplete("a").meet(incomplete("b")).reasons == {"a", "b"}
    c = compiled(args, Source("s", "s"), Join("t", "anti", "a", "s", (("site", "k"),)), s=Bound(spark.createDataFrame([("s1",)], "k string"), Coverage("proven_subset")))
    assert c.coverage("t").level == "incomplete"
    bound = compiled(args)
    assert Compiled(Plan((Source("a", "a", 2),)), {"a": Bound(args)}).coverage("a").level == "incomplete" and bound.coverage("a").complete


@pytest.mark.parametrize(
    "relations",
    [
        (Filter("f", "nowhere", ()),), (Filter("f", "a", (Test("nothing", "eq", 1),)),), (Filter("f", "a", (Test("name", "lt", "x"),)),), (Filter("f", "a", (Test("n", "in", ()),)),),
        (Filter("f", "a", (Test("n", "eq", other="name"),)),), (Project("a", "a", {"x": "n"}),), (Join("j", "inner", "a", "a", ()),), (Join("j", "inner", "a", "a", (("n", "n"),)),),
        (Join("j", "outer", "a", "a", (("n", "n"),)),), (Group("g", "a", (), {"k": Fold("count")}),), (Group("g", "a", ("site",), {"k": Fold("min", "name")}),), (Group("g", "a", ("site",), {"k": Fold("sum", "n")}),),
        (Expand("e", "a", "member_candidates"),), (Source("s", "unbound"),), (Source("s", "a", 0),),
    ],
)
def test_refusals(args, relations):
    with pytest.raises(PlanError):
        compiled(args, *relations)


def test_enum_values_are_closed(args):
    with pytest.raises(PlanError):
        Compiled(Plan((Source("a", "a"), Filter("f", "a", (Test("name", "eq", "q"),)))), {"a": Bound(args, enums={"name": ("x", "y")})})


def test_winning_tier(spark):
    subjects, found = spark.createDataFrame([("s",), ("t",)], "k string"), spark.createDataFrame([("s", True, True), ("s", False, True), ("t", False, True)], "k string, selected boolean, winning boolean")
    rows, assertion = selected_in_winning_tier("s", "c", "k")
    c = Compiled(Plan((Source("s", "s"), Source("c", "c"), *rows), (assertion,)), {"s": Bound(subjects), "c": Bound(found)})
    assert [r.k for r in c.violations(assertion).collect()] == ["t"]
