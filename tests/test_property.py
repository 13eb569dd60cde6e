"""Sequences of changes against a Python dictionary."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skarn.dml import ConstraintError
from skarn.session import Engine

KEY, VALUE = st.integers(1, 6), st.one_of(st.none(), st.integers(-50, 50))
CHANGE = st.one_of(
    st.tuples(st.just("insert"), KEY, VALUE),
    st.tuples(st.just("update"), KEY, VALUE),
    st.tuples(st.just("add"), KEY, st.integers(-5, 5)),
    st.tuples(st.just("delete"), KEY, st.none()),
    st.tuples(st.sampled_from(["begin", "commit", "rollback"]), st.just(0), st.none()),
)


@settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(CHANGE, min_size=4, max_size=9))
def test_changes(spark, tmp_path_factory, changes):
    e = Engine(spark, str(tmp_path_factory.mktemp("db") / "x"))
    e.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v INTEGER)")
    model: dict = {}
    saved: dict | None = None
    for what, k, v in changes:
        if what == "insert":
            try:
                e.execute("INSERT INTO t VALUES (?, ?)", [k, v])
                assert k not in model
                model[k] = v
            except ConstraintError:
                assert k in model
        elif what == "update":
            assert e.execute("UPDATE t SET v = ? WHERE k <= ?", [v, k]).rows == sum(x <= k for x in model)
            model = {x: v if x <= k else y for x, y in model.items()}
        elif what == "add":
            e.execute("UPDATE t SET v = v + ? WHERE v / 2 < ?", [v, k])
            model = {x: y + v if y is not None and int(y / 2) < k else y for x, y in model.items()}
        elif what == "delete":
            e.execute("DELETE FROM t WHERE k = ? OR v > 40", [k])
            model = {x: y for x, y in model.items() if x != k and not (y is not None and y > 40)}
        elif what == "begin" and saved is None:
            e.execute("BEGIN")
            saved = dict(model)
        elif what in ("commit", "rollback") and saved is not None:
            e.execute(what)
            model, saved = (model if what == "commit" else saved), None
    assert {r.k: r.v for r in e.execute("SELECT * FROM t").collect()} == model
