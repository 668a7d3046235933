import pytest

from tessera import sql_text as S
from tessera.errors import InvalidInputException


def squeezed(text):
    return " ".join(text.split())


@pytest.mark.parametrize(
    "given, want",
    [
        ("from t", "SELECT * from t"),
        ("select * exclude (a) from t", "select * EXCEPT (a) from t"),
        ('select "a b" from t', "select `a b` from t"),
        ("select a // 2 from t", "select a div 2 from t"),
        ("select 'x // \"y\"' from t", "select 'x // \"y\"' from t"),
        ("select a::INTEGER[] from t", "select a::array<int> from t"),
        ("select [1, 2], x[1:2], t.x[i], m['k'] from t", "select array(1, 2), slice(x, 1, greatest(2 - 1 + 1, 0)), try_element_at(t.x, i), m['k'] from t"),
        ("select list_filter(l, lambda x: x > 1), unnest([a])", "select filter(l, x -> x > 1), explode(array(a))"),
        ("select struct_pack(a := 1, b := f(2))", "select named_struct('a', 1, 'b', f(2))"),
        ("select (a + 1) % f(b) from t where c in ('[x]', \"y\")", "select (a + 1) % nullif(f(b), 0) from t where c in ('[x]', `y`)"),
        ("select list(v) filter (where v > 1) from t", "select transform(collect_list(struct(v AS v)) filter (where v > 1), x -> x.v) from t"),
        ("select cast(a as text), b as text from t", "select cast(a as string), b as text from t"),
        ("select strftime(d, '%Y-%m')", "select date_format(d, 'yyyy-MM')"),
        ("select a from t order by a", "select a from t order by a ASC NULLS LAST"),
        ("select a from t order by a desc, b nulls first limit 3", "select a from t order by a desc NULLS LAST, b nulls first limit 3"),
        ("select sum(a) over (partition by b order by c rows between 1 preceding and current row) from t", "select sum(a) over (partition by b order by c ASC NULLS LAST rows between 1 preceding and current row) from t"),
    ],
)
def test_rewriting(given, want):
    assert squeezed(S.spark_sql(given)) == want


def test_scripts_and_parameters():
    assert S.statements("select 1; select ';' -- ;\n; ") == ["select 1", "select ';' -- ;"]
    assert S.named_parameters("select $a, $b, $a, ?, '?'") == ["a", "b", "1"]
    assert S.bind("select ? + $2", [1, 2])[1] == {"p_1": 1, "p_2": 2}
    with pytest.raises(InvalidInputException):
        S.bind("select ?", [])
    with pytest.raises(InvalidInputException):
        S.bind("select 1", [1])
    assert S.kind("-- hi\n insert into t values (1)") == "INSERT"
    assert S.tokenize("a + 1") == [(0, "word"), (2, "op"), (4, "number")]


def test_unions_by_name():
    assert S.by_name("select 1 union all by name select 2 union by name select 3") == (["select 1", "select 2", "select 3"], [True, False])
    assert S.by_name("select 1 union all select 2") is None and S.by_name("select 'union by name'") is None


@pytest.mark.parametrize(
    "given, want",
    [
        ("select a, k from t, lateral (select k from u where u.a = t.a order by x desc, k limit 2)", "select a, k from t, lateral (SELECT * EXCEPT (__order0) FROM (select k, x AS __order0 from u where u.a = t.a order by __order0 desc NULLS LAST, k ASC NULLS LAST limit 2))"),
        ("select (select x + y z from u where u.a = t.a order by y, 1 desc, z limit 1) from t", "select (SELECT * EXCEPT (__order0) FROM (select x + y z, y AS __order0 from u where u.a = t.a order by __order0 ASC NULLS LAST, 1 desc NULLS LAST, z ASC NULLS LAST limit 1)) from t"),
        ("select * from (select u.a, f(b) as b from u order by a, b limit 2)", "select * from (select u.a, f(b) as b from u order by a ASC NULLS LAST, b ASC NULLS LAST limit 2)"),
        ("select * from (select distinct a from u order by a + 1 limit 2)", "select * from (select distinct a from u order by a + 1 ASC NULLS LAST limit 2)"),
    ],
)
def test_a_query_in_brackets_selects_what_its_limit_goes_by(given, want):
    assert squeezed(S.spark_sql(given)) == want


@pytest.mark.parametrize("form", ["SELECT c_custkey, o_orderkey FROM customer, LATERAL ({}2)", "SELECT c_custkey, ({}1) AS o FROM customer"])
def test_a_correlated_limit_keeps_its_order(spark, sf_dir, form):
    from tessera.plans.tables import views

    text = form.format("SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT ")
    plan = views(spark, sf_dir, "customer orders").sql(text).dataframe._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(o_custkey" in plan
    ordered = next(x for x in plan.splitlines() if "row_number() windowspec" in x)
    assert " DESC NULLS LAST" in ordered and " ASC NULLS LAST" in ordered
