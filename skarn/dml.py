"""INSERT, UPDATE and DELETE as DataFrames, with constraints and triggers.

Changes are staged once as files; constraint checks read the staged rows and
join them with the table, so a check costs what the change is, plus one scan of
the keys it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn import parser, triggers
from skarn.catalog import ROWID, Catalog, DataFile, ForeignKey, Table
from skarn.dialect import SqlError, Token, tokenize


class ConstraintError(RuntimeError):
    """A change that a constraint forbids."""


def run(engine, statement):
    """Run an INSERT, UPDATE or DELETE as one change."""
    from skarn.session import Status

    with engine.change() as own:
        rows = apply(engine, own, statement)
        if engine.work is None:
            check_deferred(engine, own)
    return Status(f"{rows} rows", rows)


def apply(engine, own: Catalog, statement, depth: int = 0) -> int:
    kind = {parser.Insert: _insert, parser.Update: _update, parser.Delete: _delete}[type(statement)]
    return kind(engine, own, statement, depth)


def _q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def expression(engine, own: Catalog, table: Table, text: str, alias: str | None = None) -> str:
    """Dialect text over a table's columns as Spark SQL."""
    tokens = tokenize(text)
    tables = engine.register(own, [t for t in tokens if t.text.lower() != table.name.lower()]) if any(t.word == "SELECT" for t in tokens) else []
    return engine.rewriter([table, *tables], own).sql(text)


# inserts ---------------------------------------------------------------------


def _insert(engine, own: Catalog, s: parser.Insert, depth: int) -> int:
    view = own.views.get(s.table.lower())
    if view is not None:
        return _insert_view(engine, own, s, view, depth)
    table = own.table(s.table)
    return insert_rows(engine, own, table, _source(engine, own, s, table), depth)


def _source(engine, own: Catalog, s: parser.Insert, table: Table, names: list[str] | None = None) -> DataFrame:
    """The rows of an INSERT, under the target's column names."""
    plain = [c.name for c in table.columns if c.generated is None]
    targets = [] if s.columns == ["__none"] else [table.column(n).name for n in s.columns] if s.columns else names or plain
    if s.rows is not None:
        if any(len(r) != len(targets) for r in s.rows):
            raise SqlError(f"{len(targets)} values wanted for {table.name}")
        if not targets:
            return engine.session.range(len(s.rows)).select()
        rows = [[_default(table, n) if v.upper() == "DEFAULT" else v for n, v in zip(targets, r)] for r in s.rows]
        df = _values(engine, own, s.ctes, rows)
    else:
        df = engine.query(tokenize(s.ctes + s.query), own)
    if len(df.columns) != len(targets):
        raise SqlError(f"{len(targets)} columns wanted for {table.name}, {len(df.columns)} given")
    return df.toDF(*targets)


def _values(engine, own: Catalog, ctes: str, rows: list[list[str]]) -> DataFrame:
    """Rows of expressions as one partition, so that their row ids are in order.
    Spark takes one list of values if all of them are constants of agreeing types."""
    try:
        text = ", ".join("(" + ", ".join(r) + ")" for r in rows)
        df = engine.query(tokenize(f"{ctes}SELECT * FROM VALUES {text}"), own)
    except AnalysisException:
        text = " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS c{k}" for k, v in enumerate(r)) for r in rows)
        df = engine.query(tokenize(ctes + text), own)
    return df.coalesce(1)


def _default(table: Table, name: str) -> str:
    return table.column(name).default or "NULL"


def complete(engine, own: Catalog, table: Table, df: DataFrame) -> DataFrame:
    """All columns of the table, cast, with defaults and generated values."""
    given = {c.lower() for c in df.columns}
    extra = [c for c in df.columns if c.startswith("__") or c == ROWID]
    cols = []
    for c in table.columns:
        if c.name.lower() in given:
            value = F.col(_q(c.name))
        else:
            value = F.expr(expression(engine, own, table, c.default)) if c.default and c.generated is None else F.lit(None)
        value = value.cast(c.type)
        if c.dims:
            n = F.size(value)
            value = F.when(value.isNull() | (n == c.dims), value).otherwise(F.raise_error(F.concat(F.lit(f"{table.name}.{c.name} has {c.dims} dimensions, not "), n)).cast(c.type))
        cols.append(value.alias(c.name))
    df = df.select(*extra, *cols)
    for c in table.columns:
        if c.generated is not None:
            df = df.withColumn(c.name, F.expr(expression(engine, own, table, c.generated)).cast(c.type))
    return df


def insert_rows(engine, own: Catalog, table: Table, df: DataFrame, depth: int = 0, check=None) -> int:
    """Rows are numbered by partition and place and written; if they come from
    more than the first partition, they are numbered densely in a second pass,
    without a shuffle.  Constraints and triggers read what was written."""
    first = table.next_rowid
    rows = complete(engine, own, table, df).withColumn(ROWID, F.monotonically_increasing_id() + first)
    files = engine.store.write(table, rows)
    rows = engine.store.read(table, files)
    place = F.col(ROWID) - first
    # One row a partition; Spark has the place within it in the low 33 bits.
    sizes = dict(sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright(place, 33)).count().collect()))
    total = sum(sizes.values())
    if not total:
        return 0
    if list(sizes) != [0]:
        starts, at = [], first
        for p, n in sizes.items():
            starts.append((p, at))
            at += n
        starts = F.broadcast(engine.session.createDataFrame(starts, "__p long, __s long"))
        dense = rows.join(starts, F.shiftright(place, 33) == F.col("__p")).withColumn(ROWID, F.col("__s") + place.bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__s")
        files = engine.store.write(table, dense)
        rows = engine.store.read(table, files)
    table.next_rowid = first + total
    if check is not None:
        check(rows)
    has_triggers = any(t.table.lower() == table.name.lower() and t.event == "INSERT" for t in own.triggers.values())
    if has_triggers:
        triggers.fire(engine, own, "BEFORE", "INSERT", table, None, rows, depth)
        table = own.table(table.name)
    check_rows(engine, own, table, rows, None)
    table.files = [*table.files, *files]
    table.version += 1
    if has_triggers:
        triggers.fire(engine, own, "AFTER", "INSERT", table, None, rows, depth)
    return total


def append(engine, own: Catalog, table: Table, df: DataFrame) -> int:
    return insert_rows(engine, own, table, df.toDF(*table.names()))


def _simple_view(view) -> tuple[str, list[str] | None, str | None]:
    """Base table, columns and condition of SELECT list FROM table [WHERE ...]."""
    c = parser.cursor(view.sql)
    c.need("SELECT")
    items = c.until("FROM")
    c.need("FROM")
    base = c.name()
    where = parser.raw(c.rest()) if c.take("WHERE") else None
    if c.peek() is not None:
        raise SqlError(f"view {view.name} cannot be changed")
    columns = None if [t.text for t in items] == ["*"] else parser.names_of(items)
    if columns is not None and any(len(x) != 1 for x in parser.split_commas(items)):
        raise SqlError(f"view {view.name} cannot be changed")
    return base, columns, where


def _insert_view(engine, own: Catalog, s: parser.Insert, view, depth: int) -> int:
    instead = [t for t in own.triggers.values() if t.table.lower() == view.name.lower() and t.timing == "INSTEAD OF" and t.event == "INSERT"]
    if instead:
        shape = engine.query(tokenize(f"SELECT * FROM {view.name}"), own)
        table = Table(view.name, [])
        table.columns = [_view_column(n, t) for n, t in shape.dtypes]
        rows = engine.store.stage(complete(engine, own, table, _source(engine, own, s, table)).withColumn(ROWID, F.monotonically_increasing_id()))
        triggers.fire(engine, own, "INSTEAD OF", "INSERT", table, None, rows, depth)
        return rows.count()
    base, columns, where = _simple_view(view)
    table = own.table(base)
    shown = view.columns or columns or table.names()
    real = dict(zip([x.lower() for x in shown], columns or table.names()))
    s = parser.Insert(base, [real[n.lower()] for n in s.columns], s.rows, s.query, s.ctes)
    df = _source(engine, own, s, table, list(columns or table.names()))

    def check(rows: DataFrame) -> None:
        bad = rows.where(~F.coalesce(F.expr(expression(engine, own, table, where)), F.lit(False)))
        if not bad.isEmpty():
            raise ConstraintError(f"a row does not belong to view {view.name}")

    return insert_rows(engine, own, table, df, depth, check if view.check_option and where else None)


def _view_column(name: str, kind: str):
    from skarn.catalog import Column

    return Column(name, name, kind)


# updates and deletes ---------------------------------------------------------


def _target(engine, own: Catalog, s) -> tuple[Table, str | None, object | None]:
    """Base table, condition, and the view the statement goes through."""
    view = own.views.get(s.table.lower())
    if view is None:
        return own.table(s.table), s.where, None
    base, columns, where = _simple_view(view)
    if view.columns:
        raise SqlError(f"view {view.name} renames columns and cannot be changed")
    both = " AND ".join(f"({w})" for w in (where, s.where) if w)
    return own.table(base), both or None, view


def _matched(engine, own: Catalog, table: Table, where: str | None, ctes: str) -> DataFrame:
    df = engine.store.read(table, with_file=True).alias(table.name)
    if where is None:
        return df
    names = _with_tables(engine, own, ctes)
    tokens = tokenize(where)
    tables = engine.register(own, tokens)
    del names
    return df.where(F.expr(engine.rewriter([table, *tables], own).sql(where)))


def _with_tables(engine, own: Catalog, ctes: str) -> list[str]:
    """Members of a WITH list as temporary views."""
    if not ctes:
        return []
    c = parser.cursor(ctes)
    c.need("WITH")
    c.take("RECURSIVE")
    out = []
    while True:
        name = c.name()
        columns = parser.names_of(c.group()) if c.peek().text == "(" else []
        c.need("AS")
        df = engine.query(c.group(), own)
        (df.toDF(*columns) if columns else df).createOrReplaceTempView(f"`{name}`")
        out.append(name)
        if not c.symbol(","):
            return out


def _file(path: str) -> str:
    """The last part of a path: Spark names files by job and task, so it tells
    files apart however the folders above are encoded."""
    return path.rsplit("/", 1)[1]


def replace_rows(engine, table: Table, changed: DataFrame, new: DataFrame | None) -> None:
    """Rewrite the files that hold `changed` (row id and __file): without those
    rows, and with `new` in their place."""
    touched = {_file(r[0]) for r in changed.select("__file").distinct().collect()}  # names of files
    old = [f for f in table.files if _file(f.path) in touched]
    if len(old) != len(touched):
        raise RuntimeError(f"rows of {table.name} come from files that its catalogue does not name")
    rest = engine.store.read(table, old).join(changed.select(ROWID), ROWID, "left_anti")
    rows = rest if new is None else rest.unionByName(new.select(ROWID, *[F.col(_q(c)) for c in table.names()]))
    files: list[DataFile] = engine.store.write(table, rows)
    table.files = [f for f in table.files if _file(f.path) not in touched] + files
    table.version += 1


def _update(engine, own: Catalog, s: parser.Update, depth: int) -> int:
    instead = _instead(engine, own, s, "UPDATE", depth)
    if instead is not None:
        return instead
    table, where, view = _target(engine, own, s)
    matched = _matched(engine, own, table, where, s.ctes)
    sets = {}
    for name, text in s.sets:
        c = table.column(name)
        if c.generated is not None:
            raise SqlError(f"{name} is a generated column")
        if text.upper() == "DEFAULT":
            text = c.default or "NULL"
        tokens = tokenize(text)
        tables = engine.register(own, tokens) if any(t.word == "SELECT" for t in tokens) else []
        sets[c.name] = F.expr(engine.rewriter([table, *tables], own).sql(text))
    # All right sides see the old row.
    both = matched.select(ROWID, "__file", *[F.col(_q(c)).alias(f"__old_{c}") for c in table.names()], *[(sets[c] if c in sets else F.col(_q(c))).alias(f"__new_{c}") for c in table.names()])
    staged = engine.store.stage(both)
    n = update_rows(engine, own, table, staged, list(sets), depth)
    if view is not None and view.check_option and n:
        _, _, cond = _simple_view(view)
        seen = engine.store.read(own.table(table.name)).join(staged.select(ROWID), ROWID, "left_semi")
        if cond and not seen.where(~F.coalesce(F.expr(expression(engine, own, table, cond)), F.lit(False))).isEmpty():
            raise ConstraintError(f"a row would leave view {view.name}")
    return n


def update_rows(engine, own: Catalog, table: Table, staged: DataFrame, changed: list[str], depth: int) -> int:
    """staged: row id, __file, __old_<c> and __new_<c> of each column."""
    n = staged.count()
    if not n:
        return 0
    old = staged.select(ROWID, *[F.col(_q(f"__old_{c}")).alias(c) for c in table.names()])
    new = staged.select(ROWID, *[F.col(_q(f"__new_{c}")).alias(c) for c in table.names() if table.column(c).generated is None])
    new = complete(engine, own, table, new)
    has_triggers = any(t.table.lower() == table.name.lower() and t.event == "UPDATE" for t in own.triggers.values())
    if has_triggers:
        triggers.fire(engine, own, "BEFORE", "UPDATE", table, old, new, depth, changed)
        table = own.table(table.name)
    check_rows(engine, own, table, new, staged.select(ROWID), changed)
    replace_rows(engine, table, staged.select(ROWID, "__file"), new)
    _parent_updated(engine, own, table, old, new, changed, depth)
    if has_triggers:
        triggers.fire(engine, own, "AFTER", "UPDATE", table, old, new, depth, changed)
    return n


def _delete(engine, own: Catalog, s: parser.Delete, depth: int) -> int:
    instead = _instead(engine, own, s, "DELETE", depth)
    if instead is not None:
        return instead
    table, where, _ = _target(engine, own, s)
    return delete_rows(engine, own, table, engine.store.stage(_matched(engine, own, table, where, s.ctes)), depth)


def _instead(engine, own: Catalog, s, event: str, depth: int) -> int | None:
    found = [t for t in own.triggers.values() if t.table.lower() == s.table.lower() and t.timing == "INSTEAD OF" and t.event == event]
    if not found:
        return None
    shape = engine.query(tokenize(f"SELECT * FROM {s.table}"), own)
    table = Table(s.table, [_view_column(n, t) for n, t in shape.dtypes])
    tokens = tokenize(s.where) if s.where else []
    tables = engine.register(own, tokens)
    rewriter = engine.rewriter([table, *tables], own)
    rows = shape.where(F.expr(rewriter.sql(s.where))) if s.where else shape
    rows = engine.store.stage(rows.withColumn(ROWID, F.monotonically_increasing_id()))
    new = None
    if event == "UPDATE":
        sets = {n.lower(): F.expr(rewriter.sql(v)) for n, v in s.sets}
        new = rows.select(ROWID, *[sets.get(c.lower(), F.col(_q(c))).alias(c) for c in table.names()])
    triggers.fire(engine, own, "INSTEAD OF", event, table, rows, new, depth, [n for n, _ in getattr(s, "sets", [])])
    return rows.count()


def delete_rows(engine, own: Catalog, table: Table, staged: DataFrame, depth: int) -> int:
    """staged: row id, __file and the columns of the rows to go."""
    n = staged.count()
    if not n:
        return 0
    has_triggers = any(t.table.lower() == table.name.lower() and t.event == "DELETE" for t in own.triggers.values())
    old = staged.drop("__file")
    if has_triggers:
        triggers.fire(engine, own, "BEFORE", "DELETE", table, old, None, depth)
        table = own.table(table.name)
    replace_rows(engine, table, staged.select(ROWID, "__file"), None)
    _parent_deleted(engine, own, table, old, depth)
    if has_triggers:
        triggers.fire(engine, own, "AFTER", "DELETE", table, old, None, depth)
    return n


# constraints -----------------------------------------------------------------


def check_unique(df: DataFrame, columns: list[str], what: str) -> None:
    keys = [F.col(_q(c)) for c in columns]
    known = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    if not df.where(known).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        raise ConstraintError(f"{what}: {', '.join(columns)} must be unique")


def check_rows(engine, own: Catalog, table: Table, rows: DataFrame, replaced: DataFrame | None, changed: list[str] | None = None) -> None:
    """Constraints of the table for new rows; `replaced` are the row ids whose
    former rows no longer count."""
    touched = lambda names: changed is None or any(c.lower() in [x.lower() for x in changed] for c in names)
    needed = [c.name for c in table.columns if c.not_null] + table.primary_key
    if needed and not rows.where(reduce(lambda a, b: a | b, [F.col(_q(c)).isNull() for c in needed])).isEmpty():
        raise ConstraintError(f"{table.name}: {', '.join(dict.fromkeys(needed))} must not be null")
    for text in table.checks:
        bad = rows.where(~F.coalesce(F.expr(expression(engine, own, table, text)), F.lit(True)))
        if not bad.isEmpty():
            raise ConstraintError(f"{table.name}: check ({text}) failed")
    for names in [table.primary_key, *table.uniques]:
        if not names or not touched(names):
            continue
        check_unique(rows, names, table.name)
        if table.files:
            before = engine.store.read(table)
            if replaced is not None:
                before = before.join(replaced, ROWID, "left_anti")
            if not rows.select(*map(_q, names)).join(before.select(*map(_q, names)), names, "left_semi").isEmpty():
                raise ConstraintError(f"{table.name}: {', '.join(names)} must be unique")
    for fk in table.foreign_keys:
        if touched(fk.columns) and not (fk.deferred and engine.work is not None):
            _check_child(engine, own, table, fk, rows)


def _parents(own: Catalog, fk: ForeignKey) -> tuple[Table, list[str]]:
    parent = own.table(fk.table)
    names = fk.parents or parent.primary_key
    if len(names) != len(fk.columns):
        raise SqlError(f"foreign key to {fk.table} does not name its key")
    return parent, [parent.column(n).name for n in names]


def _check_child(engine, own: Catalog, table: Table, fk: ForeignKey, rows: DataFrame) -> None:
    parent, names = _parents(own, fk)
    keys = [f"__k{k}" for k in range(len(names))]
    known = reduce(lambda a, b: a & b, [F.col(_q(c)).isNotNull() for c in fk.columns])
    child = rows.where(known).select(*[F.col(_q(c)).alias(k) for c, k in zip(fk.columns, keys)])
    held = engine.store.read(parent).select(*[F.col(_q(n)).alias(k) for n, k in zip(names, keys)])
    if parent is table:  # rows may point at each other
        held = held.unionAll(rows.select(*[F.col(_q(n)).alias(k) for n, k in zip(names, keys)]))
    if not child.join(held, keys, "left_anti").isEmpty():
        raise ConstraintError(f"{table.name}: {', '.join(fk.columns)} has no row in {parent.name}")


def check_deferred(engine, own: Catalog) -> None:
    for table in own.tables.values():
        for fk in table.foreign_keys:
            if fk.deferred and engine.base.tables.get(table.name.lower()) != table or fk.deferred and engine.base.tables.get(fk.table.lower()) != own.tables.get(fk.table.lower()):
                _check_child(engine, own, table, fk, engine.store.read(table))


def _children(own: Catalog, table: Table):
    for child in list(own.tables.values()):
        for fk in child.foreign_keys:
            if fk.table.lower() == table.name.lower():
                yield child.name, fk


def _affected(engine, own: Catalog, child: Table, fk: ForeignKey, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a child that point at keys; keys keep their names as __k<i>."""
    k = [f"__k{i}" for i in range(len(names))]
    rows = engine.store.read(child, with_file=True)
    own_keys = [F.col(_q(c)) for c in fk.columns]
    return rows.join(keys, reduce(lambda a, b: a & b, [c == F.col(n) for c, n in zip(own_keys, k)]), "inner")


def _set_children(engine, own: Catalog, child: Table, fk: ForeignKey, hit: DataFrame, values: dict, depth: int) -> None:
    cols = child.names()
    both = hit.select(ROWID, "__file", *[F.col(_q(c)).alias(f"__old_{c}") for c in cols], *[(values[c] if c in values else F.col(_q(c))).alias(f"__new_{c}") for c in cols])
    update_rows(engine, own, child, engine.store.stage(both), fk.columns, depth + 1)


def _parent_deleted(engine, own: Catalog, table: Table, old: DataFrame, depth: int) -> None:
    for name, fk in _children(own, table):
        child = own.table(name)
        _, names = _parents(own, fk)
        keys = old.select(*[F.col(_q(n)).alias(f"__k{i}") for i, n in enumerate(names)]).distinct()
        hit = _affected(engine, own, child, fk, keys, names).drop(*[f"__k{i}" for i in range(len(names))])
        if fk.on_delete == "CASCADE":
            delete_rows(engine, own, child, engine.store.stage(hit), depth + 1)
        elif fk.on_delete in ("SET NULL", "SET DEFAULT"):
            values = {child.column(c).name: _action_value(engine, own, child, c, fk.on_delete) for c in fk.columns}
            _set_children(engine, own, child, fk, hit, values, depth)
        elif not (fk.deferred and fk.on_delete == "NO ACTION" and engine.work is not None) and not hit.isEmpty():
            raise ConstraintError(f"{table.name}: rows are referenced by {child.name}")


def _action_value(engine, own: Catalog, child: Table, column: str, action: str):
    c = child.column(column)
    if action == "SET NULL" or c.default is None:
        return F.lit(None).cast(c.type)
    return F.expr(expression(engine, own, child, c.default)).cast(c.type)


def _parent_updated(engine, own: Catalog, table: Table, old: DataFrame, new: DataFrame, changed: list[str], depth: int) -> None:
    for name, fk in _children(own, table):
        child = own.table(name)
        _, names = _parents(own, fk)
        if not any(n.lower() in [c.lower() for c in changed] for n in names):
            continue
        a = old.select(ROWID, *[F.col(_q(n)).alias(f"__k{i}") for i, n in enumerate(names)])
        b = new.select(ROWID, *[F.col(_q(n)).alias(f"__n{i}") for i, n in enumerate(names)])
        moved = reduce(lambda x, y: x | y, [~F.col(f"__k{i}").eqNullSafe(F.col(f"__n{i}")) for i in range(len(names))])
        keys = a.join(b, ROWID).where(moved).drop(ROWID)
        # A key that another row still holds is not gone.
        hit = _affected(engine, own, child, fk, keys, names)
        if fk.on_update == "CASCADE":
            values = {child.column(c).name: F.col(f"__n{i}") for i, c in enumerate(fk.columns)}
            _set_children(engine, own, child, fk, hit, values, depth)
        elif fk.on_update in ("SET NULL", "SET DEFAULT"):
            values = {child.column(c).name: _action_value(engine, own, child, c, fk.on_update) for c in fk.columns}
            _set_children(engine, own, child, fk, hit, values, depth)
        elif not (fk.deferred and engine.work is not None) and not hit.isEmpty():
            raise ConstraintError(f"{table.name}: rows are referenced by {child.name}")


def references(tokens: list[Token], names: list[str]) -> bool:
    """Whether tokens name one of the columns."""
    low = {n.lower() for n in names}
    return any(t.kind in ("name", "quoted") and t.text.strip('"`').lower() in low for t in tokens)
