import math

import pytest

from millrace.functions.expr import compile_formula
from millrace.table import PlanError, Table


def value(spark, source):
    return spark.range(1).select(compile_formula(source).col.alias("v")).first()["v"]


CASES = [
    ("7/2", 3), ("7/0", math.inf), ("-7/0", -math.inf), ("7.0/2", 3.5), ("-7 % 3", -1),
    ('null == 0', True), ('null == ""', True), ("null == 0.0", True), ('null == "x"', False), ("1 == 2 | 1", True), ("1 != 2 | 1", False),
    ('"x" > "x"', False), ("3 <=> 2", 1), ('"no" ? 1 : 0', 1), ('"off" ? 1 : 0', 0), ('"" || "0"', False),
    ('"abc" =~ /b(c)/', ["bc", "c"]), ('"abc" !~ /x/', True), ('{a:1} has "a"', True), ("[1,2] has 3", False),
    ('"hello"[1:3]', "ell"), ('"hello"[3:1]', "lle"), ("[1,2,3][-1]", 3), ("[1,2,3][7]", None), ("[1,2,3][0:1]", [1, 2]),
    ('"1-3,7" as intlist', [1, 2, 3, 7]), ('"12x" as int', 0), ('"01:02:03" as time', 3723), ('3 as string', "3"),
    ("[3,1,2].sort()", [1, 2, 3]), ("[3,1,2].sort(function(a,b){return b-a;})", [3, 2, 1]), ("[1,2,3].map(function(x){return x*2;})", [2, 4, 6]),
    ("[1,2,3].filter(function(x){return x>1;})", [2, 3]), ("[5,3].reduce(function(a,b){return a+b;})", 8), ("[1,2].union([2,3])", [1, 2, 3]), ("[1,2].intersect([2,3])", [2]),
    ("range(2,5)", [2, 3, 4]), ("range(5,5)", []), ("range(5,1,-2)", [5, 3]), ("[1,2,2].counts()", {"1": 1, "2": 2}),
    ("[0,1,2,3,4,10].histogram(2)", [5, 1]), ("[0,5,10,11].histogram(2,0,10)", [1, 2]), ("[0,5,10].histogram(2,9,1)", [1, 2]),
    ('"a,b;c".split(",",";")', ["a", "b", "c"]), ('"ab".split("")', ["a", "b"]), ('" x\t".strip()', "x"), ('["a","b"].join("-")', "a-b"), ('cat("a",1)', "a1"),
    ("clamp(5,0,3)", 3.0), ("min(3,1)", 1.0), ("mean([1,2])", 1.5), ("log10(1000)", pytest.approx(3.0)), ("log(0)", None),
    ('strptime("2020-01-02","%Y-%m-%d").strftime("%d/%m/%Y")', "02/01/2020"), ('strptime("x","%Y").isnull()', True), ('aa3letter("K")', "Lys"), ('aa1letter("lys")', "K"),
    ('x=3; if(x>2){return "big";} return "small";', "big"), ('isnumeric("12")', True), ('isnumeric("a")', False), ("islist([1])", True), ('"a.b".after(".")', "b"), ('"a.b".before(".")', "a"), ('"abab".cnt("ab")', 2), ('"ab".repeat(2)', "abab"), ("inv(0)", math.inf), ("sigma([1,3])", 1.0), ("RMS([3,4,5])", pytest.approx(math.sqrt(50 / 3))), ('printf("%d-%s", 5, "x")', "5-x"), ('[[0,0],[0,1],[9,9]].clust({clustalgo:"single-link"})', "(2:6.0208,(0:0.5,1:0.5):5.5208);"), ('[["a",1],["b",2]].dic().keys()', ["a", "b"]),
]


@pytest.mark.parametrize("source,expected", CASES, ids=[c[0] for c in CASES])
def test_value(spark, source, expected):
    assert value(spark, source) == expected


def test_whole_numbers_divide_exactly(spark):
    """Beyond 2^53 too, where a quotient of doubles rounds up, as columns and in scripts."""
    from millrace.functions.script import script

    t = Table.of(spark.createDataFrame([(999999999999999999, 10**17), (-999999999999999999, 10**17), (9007199254740995, 2), (-1, 2), (0, -1), (-(2**63), -1), (7, 0)], "x long, y long").coalesce(1))
    want = [9.0, -9.0, 4503599627370497.0, 0.0, 0.0, 2.0**63, math.inf]
    for made in (compile_formula("$x/$y", t).col, script("q=0; for(i=0;i<1;i++){ q=$x/$y; } return q;", t, "double")):
        got = [r[0] for r in t.df.orderBy("_row").select(made).collect()]
        assert got == want and not any(math.copysign(1, v) < 0 for v in got if v == 0)


@pytest.mark.parametrize("source", ["1 +", "for(;;){}", "nothing", "f(1)", "$0", "[1", "~"])
def test_refused(spark, source):
    with pytest.raises(PlanError):
        compile_formula(source)


def test_columns_by_index_name_and_homonym(spark):
    t = Table.of(spark.createDataFrame([(1, "a")], "n long, s string"))
    t = t.with_columns([("x", t.col(0)), ("x", t.col(1)), ("y", t.col(0))])
    assert t.index({"name": "x", "num": 1}) == 1
    assert t.indexes({"regex": "x", "negate": True}) == [2]
    assert t.result().columns == ["x", "x_2", "y"]
    with pytest.raises(PlanError):
        t.index("z")
    assert t.indexes({"name": "z", "optional": True}) == []


def test_scripts_with_loops(spark):
    from millrace.functions.script import script

    t = Table.of(spark.createDataFrame([(4, "a"), (None, "b"), (0, None)], "n long, s string").coalesce(1))
    run = lambda source, kind="double": [r[0] for r in t.df.orderBy("_row").select(script(source, t, kind)).collect()]
    assert run("s=0; for(i=1;i<=$n;i++){ if(i==3){continue;} s+=i; } return s;") == [7.0, 0.0, 0.0]
    assert run('x=""; while(x.dim() < 3){ x = cat(x, $s); if($s == null){break;} } x', "string") == ["aaa", "bbb", ""]
    assert run("f=function(a){return a*2;}; f(3)/0", "double") == [math.inf] * 3
    assert run("$n == null", "boolean") == [False, True, True]
    with pytest.raises(Exception, match="too long"):
        run("while(1){}")


def test_branches_that_set_names_and_loops_in_stages(spark):
    from millrace.plans.pipeline import Pipeline

    p = Pipeline(spark, {"t": spark.createDataFrame([(1,), (3,)], "a int")})
    stages = [
        {"op": "predefine", "arg": {"name": "top", "value": 2}},
        {"op": "appendcol", "arg": {"name": "b", "formula": "x = 1; if ($a > top) { x = 5; x += 1; } x * 10"}},
        {"op": "appendcol", "arg": {"name": "c", "type": "int", "formula": "n = 0; for (i = 0; i <= $a; i++) { n += i * top; } n"}},
    ]
    assert [tuple(r) for r in p.run(stages, "t").result().orderBy("a").collect()] == [(1, 10, 2), (3, 60, 12)]


@pytest.mark.parametrize("source", ["range(0,9).histogram(3)", "range(0,9).histogram(3,1,7)", "range(0,9).counts()", "range(0,9).sigma()", "range(0,9).mean()"])
def test_the_list_of_a_statistic_is_computed_once(source):
    """Else it is made again for each of its elements, and the work grows with a power of the list."""
    assert str(compile_formula(source).col).count("sequence(") == (2 if "histogram" in source else 1)


def test_statistics_of_long_and_empty_lists(spark):
    assert value(spark, "range(0,3000).histogram(100)") == [30] * 100
    assert value(spark, "range(0,0).histogram(3)") == [0, 0, 0]
    assert value(spark, "range(0,600).counts().dim()") == 600
    assert value(spark, '[["a",1],["b",2],["a",3]].dic().kv()') == [["a", "3"], ["b", "2"]]
    assert value(spark, '["x"].sigma()') is None
