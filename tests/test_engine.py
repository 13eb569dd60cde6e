"""The engine: exact values of small fixtures, one behaviour a test."""

import pytest

from skarn.dialect import SqlError, statements
from skarn.dml import ConstraintError
from skarn.session import Engine, Pool, Status, shell
from skarn.store import ConflictError


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(e, sql, *params):
    return [tuple(r) for r in e.execute(sql, list(params)).collect()]


def load(e):
    e.execute_script("""
        CREATE TABLE users (user_id INTEGER PRIMARY KEY, user_name TEXT);
        CREATE TABLE orders (order_id INTEGER, uid INTEGER, amount INTEGER);
        INSERT INTO users VALUES (1, 'Alice'), (2, 'Bob'), (3, 'Charlie');
        INSERT INTO orders VALUES (1, 1, 100), (2, 1, 200), (3, 2, 150);
    """)


def test_inner_and_left_join(e):
    load(e)
    got = rows(e, "SELECT * FROM users JOIN orders ON user_id = uid ORDER BY order_id")
    assert got == [(1, "Alice", 1, 1, 100), (1, "Alice", 2, 1, 200), (2, "Bob", 3, 2, 150)]
    left = rows(e, "SELECT user_name, amount FROM users LEFT JOIN orders ON user_id = uid ORDER BY user_id, order_id")
    assert left[-1] == ("Charlie", None) and len(left) == 4


def test_having_and_in(e):
    e.execute("CREATE TABLE emp (id INTEGER, dept TEXT, salary INTEGER)")
    e.execute("INSERT INTO emp VALUES (1,'HR',3000),(2,'HR',4000),(3,'IT',5000),(4,'IT',6000),(5,'IT',7000),(6,'Sales',2000)")
    assert len(rows(e, "SELECT dept, COUNT(*) FROM emp GROUP BY dept HAVING dept != 'Sales'")) == 2
    assert rows(e, "SELECT id FROM emp WHERE id IN (2, 4) ORDER BY id") == [(2,), (4,)]
    assert rows(e, "SELECT dept FROM emp GROUP BY dept HAVING SUM(salary) > 6999 ORDER BY dept") == [("HR",), ("IT",)]


def test_limit_offset(e):
    e.execute("CREATE TABLE t (n INTEGER)")
    e.execute("INSERT INTO t VALUES (1),(2),(3),(4),(5)")
    assert rows(e, "SELECT n FROM t ORDER BY n LIMIT 2 OFFSET 2") == [(3,), (4,)]
    assert rows(e, "SELECT n FROM t ORDER BY n LIMIT 10 OFFSET 10") == []


def test_integer_division(e):
    assert rows(e, "SELECT 7 / 2, -7 / 2, 7 / 0, 7.0 / 2, 12 / 5 / 2, 2 * 7 / 4") == [(3, -3, None, 3.5, 1, 3)]
    e.execute("CREATE TABLE t (a INTEGER, b INTEGER, x REAL)")
    e.execute("INSERT INTO t VALUES (7, 2, 7.0), (9, 0, 1.0)")
    assert rows(e, "SELECT a / b, x / b, SUM(a) / COUNT(*) FROM t GROUP BY a, b, x ORDER BY a") == [(3, 3.5, 7), (None, None, 9)]


def test_strings_and_comments(e):
    assert rows(e, "SELECT 'it''s', 'a\\b' -- note\n, 'x;y' /* more */") == [("it's", "a\\b", "x;y")]
    with pytest.raises(SqlError):
        e.execute("SELECT 'open")


def test_rowid(e):
    load(e)
    assert rows(e, "SELECT * FROM users WHERE rowid = 2") == [(2, "Bob")]
    assert rows(e, "SELECT rowid, user_name FROM users WHERE rowid BETWEEN 2 AND 3 ORDER BY rowid") == [(2, "Bob"), (3, "Charlie")]


def test_prepared_parameters_and_cache(e):
    load(e)
    p = e.prepare("SELECT amount FROM orders WHERE uid = ? AND amount > ?")
    assert p.parameters == 2
    assert [tuple(r) for r in e.execute_prepared(p, [1, 150]).collect()] == [(200,)]
    e.prepare("SELECT amount FROM orders WHERE uid = ? AND amount > ?")
    assert e.cache_stats().hits >= 1
    with pytest.raises(SqlError):
        e.execute_prepared(p, [1])
    e.execute("INSERT INTO users VALUES (?, ?)", [9, "O'Hara"])
    assert rows(e, "SELECT user_name FROM users WHERE user_name = ?", "O'Hara") == [("O'Hara",)]


def test_update_sees_old_rows(e):
    e.execute("CREATE TABLE t (a INTEGER, b INTEGER)")
    e.execute("INSERT INTO t VALUES (1, 10), (2, 20)")
    assert e.execute("UPDATE t SET a = b, b = a WHERE a = 1").rows == 1
    assert rows(e, "SELECT * FROM t ORDER BY b") == [(10, 1), (2, 20)]


def test_update_and_delete_with_subquery(e):
    load(e)
    e.execute("UPDATE orders SET amount = amount + (SELECT MAX(amount) FROM orders) WHERE uid IN (SELECT user_id FROM users WHERE user_name = 'Bob')")
    assert rows(e, "SELECT amount FROM orders ORDER BY order_id") == [(100,), (200,), (350,)]
    assert e.execute("DELETE FROM orders WHERE amount > 150").rows == 2
    assert rows(e, "SELECT order_id FROM orders") == [(1,)]


def test_delete_keeps_nulls(e):
    e.execute("CREATE TABLE t (a INTEGER)")
    e.execute("INSERT INTO t VALUES (1), (NULL)")
    e.execute("DELETE FROM t WHERE a > 0")
    assert rows(e, "SELECT a FROM t") == [(None,)]


def test_with_before_changes(e):
    load(e)
    e.execute("WITH big AS (SELECT uid FROM orders WHERE amount >= 200) DELETE FROM users WHERE user_id IN (SELECT uid FROM big)")
    assert rows(e, "SELECT user_id FROM users ORDER BY 1") == [(2,), (3,)]
    e.execute("WITH x AS (SELECT 7 AS k) INSERT INTO users SELECT k, 'seven' FROM x")
    assert (7, "seven") in rows(e, "SELECT * FROM users")


def test_defaults_generated_and_checks(e):
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, price INTEGER NOT NULL CHECK (price > 0), qty INTEGER DEFAULT 2, total INTEGER GENERATED ALWAYS AS (price * qty))")
    e.execute("INSERT INTO t (id, price) VALUES (1, 5)")
    e.execute("INSERT INTO t VALUES (2, 3, 4)")
    assert rows(e, "SELECT * FROM t ORDER BY id") == [(1, 5, 2, 10), (2, 3, 4, 12)]
    e.execute("UPDATE t SET qty = 10 WHERE id = 1")
    assert rows(e, "SELECT total FROM t WHERE id = 1") == [(50,)]
    for bad in ("INSERT INTO t (id, price) VALUES (3, -1)", "INSERT INTO t (id) VALUES (4)", "INSERT INTO t (id, price) VALUES (1, 1)", "UPDATE t SET id = 2 WHERE id = 1"):
        with pytest.raises(ConstraintError):
            e.execute(bad)
    assert len(rows(e, "SELECT * FROM t")) == 2


def test_composite_key_and_unique_index(e):
    e.execute("CREATE TABLE m (a INTEGER, b INTEGER, c TEXT, PRIMARY KEY (a, b))")
    e.execute("INSERT INTO m VALUES (1, 1, 'x'), (1, 2, 'y')")
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO m VALUES (1, 2, 'z')")
    e.execute("CREATE UNIQUE INDEX ix ON m (c)")
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO m VALUES (3, 3, 'x')")
    e.execute("DROP INDEX ix")
    e.execute("INSERT INTO m VALUES (3, 3, 'x')")


FK = "CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE c (id INTEGER, pid INTEGER DEFAULT 1 REFERENCES p(id) {}); INSERT INTO p VALUES (1,'a'),(2,'b'),(3,'c'); INSERT INTO c VALUES (10,1),(20,2),(21,2),(30,NULL)"


@pytest.mark.parametrize(
    ("action", "want"),
    [("ON DELETE CASCADE", [(10, 1), (30, None)]), ("ON DELETE SET NULL", [(10, 1), (20, None), (21, None), (30, None)]), ("ON DELETE SET DEFAULT", [(10, 1), (20, 1), (21, 1), (30, None)])],
)
def test_fk_delete_actions(e, action, want):
    e.execute_script(FK.format(action))
    e.execute("DELETE FROM p WHERE id = 2")
    assert rows(e, "SELECT * FROM c ORDER BY id") == want


def test_fk_restrict_and_child_checks(e):
    e.execute_script(FK.format("ON DELETE RESTRICT"))
    with pytest.raises(ConstraintError):
        e.execute("DELETE FROM p WHERE id = 2")
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO c VALUES (40, 99)")
    with pytest.raises(ConstraintError):
        e.execute("UPDATE c SET pid = 99 WHERE id = 10")
    e.execute("DELETE FROM p WHERE id = 3")
    with pytest.raises(SqlError):
        e.execute("DROP TABLE p")


def test_fk_update_cascade(e):
    e.execute_script(FK.format("ON UPDATE CASCADE"))
    e.execute("UPDATE p SET id = id + 100")
    assert rows(e, "SELECT pid FROM c ORDER BY id") == [(101,), (102,), (102,), (None,)]


def test_fk_cascade_through_tables_and_cycles(e):
    e.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, parent INTEGER REFERENCES n(id) ON DELETE CASCADE)")
    e.execute("INSERT INTO n VALUES (1, NULL), (2, 1), (3, 2), (4, 3), (5, NULL)")
    e.execute("DELETE FROM n WHERE id = 1")
    assert rows(e, "SELECT id FROM n") == [(5,)]


def test_deferred_foreign_key(e):
    e.execute("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    e.execute("CREATE TABLE c (pid INTEGER REFERENCES p(id) DEFERRABLE INITIALLY DEFERRED)")
    e.execute("BEGIN")
    e.execute("INSERT INTO c VALUES (1)")
    e.execute("INSERT INTO p VALUES (1)")
    e.execute("COMMIT")
    e.execute("BEGIN")
    e.execute("INSERT INTO c VALUES (2)")
    with pytest.raises(ConstraintError):
        e.execute("COMMIT")
    e.execute("ROLLBACK")
    assert rows(e, "SELECT pid FROM c") == [(1,)]


def test_transactions(e):
    load(e)
    e.execute("BEGIN")
    e.execute("UPDATE users SET user_name = 'X'")
    e.execute("DELETE FROM orders")
    assert rows(e, "SELECT COUNT(*) FROM orders") == [(0,)]
    e.execute("ROLLBACK")
    assert rows(e, "SELECT COUNT(*) FROM orders") == [(3,)]
    assert rows(e, "SELECT user_name FROM users WHERE user_id = 1") == [("Alice",)]
    for bad in ("COMMIT", "ROLLBACK"):
        with pytest.raises(SqlError):
            e.execute(bad)
    e.execute("BEGIN")
    with pytest.raises(SqlError):
        e.execute("BEGIN")
    e.execute("SAVEPOINT a")
    e.execute("DELETE FROM users")
    e.execute("ROLLBACK TO a")
    e.execute("RELEASE a")
    e.execute("COMMIT")
    assert rows(e, "SELECT COUNT(*) FROM users") == [(3,)]


def test_failed_statement_changes_nothing(e):
    load(e)
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO users VALUES (4, 'Dora'), (1, 'Twice')")
    assert rows(e, "SELECT COUNT(*) FROM users") == [(3,)]


def test_snapshots_and_conflicts(e, spark):
    load(e)
    reader = e.snapshot()
    other = Engine(spark, e.path)
    e.execute("BEGIN")
    e.execute("DELETE FROM orders WHERE order_id = 1")
    other.execute("INSERT INTO orders VALUES (9, 3, 1)")
    with pytest.raises(ConflictError):
        e.execute("COMMIT")
    assert rows(e, "SELECT COUNT(*) FROM orders") == [(4,)]
    assert rows(reader, "SELECT COUNT(*) FROM orders") == [(3,)]
    e.execute("BEGIN")
    e.execute("DELETE FROM orders")
    other.execute("INSERT INTO users VALUES (4, 'Dora')")
    e.execute("COMMIT")  # different tables
    assert rows(other, "SELECT (SELECT COUNT(*) FROM users), (SELECT COUNT(*) FROM orders)") == [(4, 0)]
    with pytest.raises(SqlError):
        reader.execute("DELETE FROM users")


def test_reopen_and_vacuum(e, spark):
    load(e)
    e.execute("UPDATE users SET user_name = 'Z' WHERE user_id = 1")
    again = Engine.open(spark, e.path)
    assert again.vacuum() == 0  # others may still read what was replaced
    assert again.vacuum(retain=0) > 0
    assert rows(again, "SELECT user_name FROM users ORDER BY user_id") == [("Z",), ("Bob",), ("Charlie",)]
    assert again.list_tables() == ["orders", "users"]
    assert [f.name for f in again.get_table_schema("users")] == ["user_id", "user_name"]


def test_path_with_space_and_signs(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "a b%20c+d"))
    e.execute("CREATE TABLE t (id INTEGER, v INTEGER)")
    e.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    e.execute("UPDATE t SET v = 9 WHERE id = 1")
    assert rows(e, "SELECT * FROM t ORDER BY id") == [(1, 9), (2, 2)]
    e.execute("DELETE FROM t WHERE id = 2")
    assert rows(e, "SELECT * FROM t") == [(1, 9)]


def test_vacuum_beside_other_sessions(e, spark):
    load(e)
    a, b, old = Engine.open(spark, e.path), Engine.open(spark, e.path), e.snapshot()
    b.execute("INSERT INTO users VALUES (4, 'Dora')")
    b.execute("UPDATE users SET user_name = 'Y' WHERE user_id = 2")
    a.execute("VACUUM")
    assert rows(b, "SELECT COUNT(*) FROM users") == [(4,)]
    a.execute("VACUUM 0")  # b's version is the newest, old's is held
    assert rows(b, "SELECT user_name FROM users ORDER BY user_id") == [("Alice",), ("Y",), ("Charlie",), ("Dora",)]
    assert rows(old, "SELECT user_name FROM users ORDER BY user_id") == [("Alice",), ("Bob",), ("Charlie",)]
    assert rows(a, "SELECT COUNT(*) FROM users") == [(4,)]
    kept = len(a.store._listed("catalog"))
    old.close()
    assert a.vacuum(retain=0) > 0 and len(a.store._listed("catalog")) < kept
    late = b.store.load()
    late.version -= 3  # its documents are gone, and still no version is written twice
    with pytest.raises(ConflictError):
        b.store.publish(late)


def test_many_values(e):
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL)")
    text = ", ".join(f"({k}, 'it''s {k}', {k}.5)" if k % 3 else f"({k}, NULL, -{k})" for k in range(10_000))
    assert e.execute(f"INSERT INTO t VALUES {text}").rows == 10_000
    assert rows(e, "SELECT COUNT(*), SUM(id), COUNT(name), MIN(rowid), MAX(rowid) FROM t") == [(10_000, 49_995_000, 6666, 1, 10_000)]
    assert rows(e, "SELECT id, name, x FROM t WHERE rowid = 4321") == [(4320, None, -4320.0)]
    e.execute("INSERT INTO t SELECT id + 10000, name, x FROM t")
    assert rows(e, "SELECT COUNT(DISTINCT rowid), MAX(rowid) FROM t") == [(20_000, 20_000)]
    e.execute("INSERT INTO t VALUES (50000, (SELECT MAX(name) FROM t), 1), (50001, 'a' || 'b', 7 / 2)")
    assert rows(e, "SELECT name, x FROM t WHERE id >= 50000 ORDER BY id") == [("it's 9998", 1.0), ("ab", 3.0)]


def test_rows_of_many_partitions_are_numbered_densely(e, spark):
    e.attach("wide", spark.range(0, 1000, 1, 7).selectExpr("id", "id * 2 AS v"))
    e.execute("CREATE TABLE t AS SELECT id, v FROM wide")
    assert rows(e, "SELECT COUNT(DISTINCT rowid), MIN(rowid), MAX(rowid) FROM t") == [(1000, 1, 1000)]
    assert rows(e, "SELECT COUNT(*) FROM t WHERE rowid <> id + 1") == [(0,)]


def test_alter_table(e):
    load(e)
    e.execute("ALTER TABLE users ADD COLUMN age INTEGER DEFAULT 7")
    e.execute("INSERT INTO users VALUES (4, 'Dora', NULL)")
    e.execute("ALTER TABLE users RENAME COLUMN user_name TO name")
    assert rows(e, "SELECT * FROM users ORDER BY user_id") == [(1, "Alice", 7), (2, "Bob", 7), (3, "Charlie", 7), (4, "Dora", None)]
    e.execute("ALTER TABLE users DROP COLUMN name")
    e.execute("ALTER TABLE users RENAME TO people")
    assert rows(e, "SELECT * FROM people WHERE user_id = 4") == [(4, None)]
    with pytest.raises(SqlError):
        e.execute("ALTER TABLE people DROP COLUMN user_id")


def test_create_drop_flags(e):
    e.execute("CREATE TABLE t (a INTEGER)")
    e.execute("CREATE TABLE IF NOT EXISTS t (a INTEGER)")
    with pytest.raises(SqlError):
        e.execute("CREATE TABLE t (a INTEGER)")
    e.execute("DROP TABLE t")
    e.execute("DROP TABLE IF EXISTS t")
    with pytest.raises(SqlError):
        e.execute("DROP TABLE t")
    with pytest.raises(SqlError):
        e.execute("CREATE TABLE u (a NOSUCHTYPE)")


def test_views_and_check_option(e):
    load(e)
    e.execute("CREATE VIEW big AS SELECT * FROM orders WHERE amount > 120 WITH CHECK OPTION")
    e.execute("CREATE VIEW names(n) AS SELECT user_name FROM users")
    assert rows(e, "SELECT COUNT(*) FROM big") == [(2,)]
    assert rows(e, "SELECT n FROM names ORDER BY n LIMIT 1") == [("Alice",)]
    e.execute("INSERT INTO big VALUES (4, 3, 500)")
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO big VALUES (5, 3, 1)")
    with pytest.raises(ConstraintError):
        e.execute("UPDATE big SET amount = 1 WHERE order_id = 2")
    e.execute("DELETE FROM big WHERE order_id = 1")  # not in the view
    assert rows(e, "SELECT COUNT(*) FROM orders") == [(4,)]
    e.execute("DROP VIEW big")
    with pytest.raises(SqlError):
        e.execute("DROP VIEW big")


def test_triggers(e):
    load(e)
    e.execute("CREATE TABLE log (what TEXT, id INTEGER)")
    e.execute("CREATE TABLE totals (uid INTEGER, total INTEGER, last INTEGER)")
    e.execute("INSERT INTO totals VALUES (1, 0, 0), (2, 0, 0)")
    e.execute("CREATE TRIGGER a AFTER INSERT ON orders FOR EACH ROW WHEN NEW.amount > 10 BEGIN INSERT INTO log VALUES ('in', NEW.order_id); UPDATE totals SET total = total + NEW.amount, last = NEW.order_id WHERE uid = NEW.uid; END")
    e.execute("CREATE TRIGGER b AFTER UPDATE OF amount ON orders BEGIN INSERT INTO log SELECT 'up', OLD.amount * 1000 + NEW.amount; END")
    e.execute("CREATE TRIGGER c BEFORE DELETE ON users BEGIN DELETE FROM orders WHERE uid = OLD.user_id; END")
    e.execute("INSERT INTO orders VALUES (4, 1, 50), (5, 1, 60), (6, 2, 5)")
    assert rows(e, "SELECT * FROM totals ORDER BY uid") == [(1, 110, 5), (2, 0, 0)]
    e.execute("UPDATE orders SET amount = 51 WHERE order_id = 4")
    e.execute("UPDATE orders SET uid = 2 WHERE order_id = 4")
    assert rows(e, "SELECT * FROM log ORDER BY id") == [("in", 4), ("in", 5), ("up", 50051)]
    e.execute("DELETE FROM users WHERE user_id = 2")
    assert rows(e, "SELECT order_id FROM orders ORDER BY 1") == [(1,), (2,), (5,)]
    assert e.list_triggers() == ["a", "b", "c"]
    e.execute("ALTER TRIGGER b DISABLE")
    e.execute("DROP TRIGGER a")
    e.execute("INSERT INTO orders VALUES (7, 1, 50)")
    assert rows(e, "SELECT COUNT(*) FROM log") == [(3,)]


def test_instead_of_trigger(e):
    load(e)
    e.execute("CREATE VIEW v AS SELECT user_id, user_name FROM users")
    e.execute("CREATE TRIGGER i INSTEAD OF INSERT ON v BEGIN INSERT INTO users VALUES (NEW.user_id + 100, NEW.user_name); END")
    e.execute("INSERT INTO v VALUES (1, 'New')")
    assert rows(e, "SELECT user_id FROM users WHERE user_name = 'New'") == [(101,)]


def test_trigger_recursion_stops(e):
    e.execute("CREATE TABLE t (n INTEGER)")
    e.execute("CREATE TRIGGER r AFTER INSERT ON t WHEN NEW.n < 4 BEGIN INSERT INTO t VALUES (NEW.n + 1); END")
    e.execute("INSERT INTO t VALUES (1)")
    assert rows(e, "SELECT n FROM t ORDER BY n") == [(1,), (2,), (3,), (4,)]


def test_vectors(e):
    e.execute("CREATE TABLE v (id INTEGER, emb VECTOR(3))")
    e.execute("INSERT INTO v VALUES (1, [1, 0, 0]), (2, [0, 1, 0]), (3, [1, 1, 0])")
    e.execute("CREATE INDEX ix ON v USING HNSW (emb)")
    got = rows(e, "SELECT id, L2_DISTANCE(emb, [1, 0, 0]) AS d FROM v ORDER BY d LIMIT 2")
    assert got == [(1, 0.0), (3, 1.0)]
    assert rows(e, "SELECT id FROM v ORDER BY L2_DISTANCE(emb, [0, 1, 0]), id LIMIT 1") == [(2,)]
    assert rows(e, "SELECT id FROM v WHERE COSINE_SIMILARITY(emb, [1, 0, 0]) > 0.9") == [(1,)]
    assert rows(e, "SELECT VECTOR_COSINE_SIMILARITY(emb, [0, 0, 0]) FROM v WHERE id = 1") == [(0.0,)]
    with pytest.raises(Exception, match="dimensions"):
        e.execute("INSERT INTO v VALUES (4, [1, 2])")
    with pytest.raises(Exception, match="dimensions"):
        e.execute("SELECT L2_DISTANCE(emb, [1, 2]) FROM v").collect()
    with pytest.raises(SqlError):
        e.execute("CREATE INDEX bad ON v USING HNSW (id)")


def test_json(e):
    doc = '{"person": {"name": "John", "age": 30, "ok": true, "tags": [1, 2]}}'
    assert rows(e, f"SELECT JSON_EXTRACT('{doc}', '$.person.name'), JSON_EXTRACT('{doc}', '$.person.age'), JSON_EXTRACT('{doc}', '$.person.ok'), JSON_EXTRACT('{doc}', '$.person.tags[1]'), JSON_EXTRACT('{doc}', '$.none')") == [("John", "30", "1", "2", None)]
    assert rows(e, "SELECT JSON_TYPE('{\"a\": 1}', '$.a'), JSON_TYPE('{\"a\": \"text\"}', '$.a'), JSON_TYPE('[1]'), JSON_TYPE('{}'), JSON_TYPE('null'), JSON_TYPE('{')") == [("real", "text", "array", "object", "null", None)]
    assert rows(e, "SELECT JSON_VALID('{}'), JSON_VALID('{'), JSON_ARRAY(1, 'a', NULL, 1.5), JSON_OBJECT('k', 1, 'l', 'v')") == [(True, False, '[1,"a",null,1.5]', '{"k":1,"l":"v"}')]


def test_full_text(e):
    e.execute("CREATE VIRTUAL TABLE d USING FTS5(title, body)")
    e.execute("INSERT INTO d VALUES ('Hello', 'Hello World! This is a test.'), ('Other', 'World peace; no test here'), ('Third', 'nothing')")
    assert rows(e, "SELECT title FROM d WHERE d MATCH 'world test' ORDER BY title") == [("Hello",), ("Other",)]
    assert rows(e, "SELECT title FROM d WHERE body MATCH '\"hello world\"'") == [("Hello",)]
    assert rows(e, "SELECT title FROM d WHERE d MATCH 'test -peace'") == [("Hello",)]
    assert rows(e, "SELECT title FROM d WHERE d MATCH 'title:third OR peace' ORDER BY title") == [("Other",), ("Third",)]
    assert rows(e, "SELECT HIGHLIGHT(body, 'world test') FROM d WHERE title = 'Hello'") == [("Hello **World**! This is a **test**.",)]
    e.execute("UPDATE d SET body = 'peace at last' WHERE title = 'Third'")
    e.execute("DELETE FROM d WHERE title = 'Other'")
    assert rows(e, "SELECT title FROM d WHERE d MATCH 'peace'") == [("Third",)]


def test_rtree(e):
    e.execute("CREATE VIRTUAL TABLE r USING RTREE(id, min_x, max_x, min_y, max_y)")
    e.execute("INSERT INTO r VALUES (1,0,10,0,10),(2,5,15,5,15),(3,20,30,20,30)")
    assert rows(e, "SELECT id FROM r WHERE min_x <= 12 AND max_x >= 4 AND min_y <= 12 AND max_y >= 4 ORDER BY id") == [(1,), (2,)]
    assert rows(e, "SELECT id FROM r WHERE bbox_intersects(min_x, max_x, min_y, max_y, 4, 12, 4, 12) ORDER BY id") == [(1,), (2,)]
    assert rows(e, "SELECT id FROM r ORDER BY bbox_distance(min_x, max_x, min_y, max_y, 0, 0), id LIMIT 2") == [(1,), (2,)]


def test_any_all_and_recursive(e):
    load(e)
    assert rows(e, "SELECT user_id FROM users WHERE user_id > ALL (SELECT uid FROM orders)") == [(3,)]
    assert rows(e, "SELECT user_id FROM users WHERE user_id = ANY (SELECT uid FROM orders) ORDER BY 1") == [(1,), (2,)]
    assert rows(e, "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT SUM(n) FROM t") == [(15,)]


def test_batch_pool_and_shell(e, spark):
    load(e)
    with e.batch():
        for k in range(3):
            e.execute(f"INSERT INTO orders VALUES ({10 + k}, 3, {k})")
    assert rows(e, "SELECT COUNT(*) FROM orders") == [(6,)]
    pool = Pool(spark, e.path, 1)
    with pool.engine() as p:
        assert rows(p, "SELECT COUNT(*) FROM orders") == [(6,)]
    out = list(shell(spark, e.path, [".tables", ".schema users", "SELECT COUNT(*) FROM users;", "SELEC 1", ".dbinfo", ".quit", "SELECT 1"]))
    assert out[0] == "orders\nusers" and out[1].startswith("users(user_id bigint") and out[2] == "3" and out[3].startswith("error") and len(out) == 5


def test_statements_split():
    script = "SELECT 'a;b'; CREATE TRIGGER t AFTER INSERT ON x BEGIN INSERT INTO y VALUES (CASE WHEN 1 THEN 2 END); DELETE FROM z; END; SELECT 2"
    assert len(statements(script)) == 3


def test_status(e):
    assert isinstance(e.execute("CREATE TABLE t (a INTEGER)"), Status)
    assert e.execute("INSERT INTO t VALUES (1), (2)").rows == 2
    with pytest.raises(SqlError):
        e.execute("FROBNICATE t")
    assert "Scan" in e.execute("EXPLAIN SELECT * FROM t").message


def test_shell_shows_all_rows_in_pages(e, spark):
    e.execute("CREATE TABLE n (id INTEGER)")
    e.execute("INSERT INTO n VALUES " + ", ".join(f"({i})" for i in range(32)))
    out = list(shell(spark, e.path, ["SELECT a.id FROM n a CROSS JOIN n b", "SELECT a.id FROM n a CROSS JOIN n b WHERE a.id < 31"]))
    assert [x.count("\n") for x in out] == [999, 23, 991]
