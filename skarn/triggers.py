"""Row triggers, evaluated for all rows of a statement at once.

The rows of a statement form a transition table with old_<c> and new_<c>; NEW.c
and OLD.c in conditions and bodies are its columns.  A body INSERT selects from
the transition table; a DELETE removes rows for which some transition row
satisfies its condition; an UPDATE joins target and transition rows.  Where
several transition rows meet one target row, `c = c + x` and `c = c - x` add up,
assignments that do not read the target keep the last row's value, and anything
else is refused rather than run in an order that rows do not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn import parser
from skarn.catalog import ROWID, Catalog, Table, Trigger
from skarn.dialect import SqlError, Token, tokenize, unquote

MAX_DEPTH = 16
TRANSITION = "__transition"


def fire(engine, own: Catalog, timing: str, event: str, table: Table, old: DataFrame | None, new: DataFrame | None, depth: int, changed: list[str] | None = None) -> None:
    found = [t for _, t in sorted(own.triggers.items()) if t.enabled and t.timing == timing and t.event == event and t.table.lower() == table.name.lower()]
    found = [t for t in found if not t.columns or changed is None or {c.lower() for c in t.columns} & {c.lower() for c in changed}]
    if not found:
        return
    if depth >= MAX_DEPTH:
        raise SqlError(f"triggers nest deeper than {MAX_DEPTH}")
    rows = transition(table, old, new)
    for t in found:
        _run(engine, own, t, table, engine.store.stage(rows), depth)


def transition(table: Table, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    side = lambda df, p: df.select(F.col(ROWID).alias("__row"), *[F.col(f"`{c}`").alias(f"{p}_{c.lower()}") for c in table.names()])
    if old is None:
        return side(new, "new")
    if new is None:
        return side(old, "old")
    return side(old, "old").join(side(new, "new"), "__row")


def bind(tokens: list[Token]) -> list[Token]:
    """NEW.c and OLD.c as columns of the transition table."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.word in ("NEW", "OLD") and i + 2 < len(tokens) and tokens[i + 1].text == ".":
            out += [Token("name", TRANSITION), Token("op", "."), Token("quoted", f'"{t.word.lower()}_{unquote(tokens[i + 2]).lower()}"')]
            i += 3
        else:
            out.append(t)
            i += 1
    return out


def _mentions(tokens: list[Token]) -> bool:
    return any(t.text == TRANSITION for t in tokens)


def _run(engine, own: Catalog, trigger: Trigger, table: Table, rows: DataFrame, depth: int) -> None:
    from skarn import dml

    shown = Table(TRANSITION, [dml._view_column(n, t) for n, t in rows.dtypes])
    rewriter = engine.rewriter([shown], own)
    rows = rows.alias(TRANSITION)
    if trigger.when:
        tokens = bind(tokenize(trigger.when))
        tables = engine.register(own, tokens)
        rows = rows.where(F.expr(engine.rewriter([shown, *tables], own).sql(parser.raw(tokens))))
    if rows.isEmpty():
        return
    for text in trigger.body:
        c = parser.Cursor(tokenize(text))
        kind = c.word()
        c.at = 1
        rows.createOrReplaceTempView(TRANSITION)
        engine.external[TRANSITION] = rows
        if kind == "INSERT":
            _insert(engine, own, parser.insert(c), depth)
        elif kind == "DELETE":
            _delete(engine, own, parser.delete(c), depth)
        elif kind == "UPDATE":
            _update(engine, own, parser.update(c), rows, shown, rewriter, depth)
        else:
            raise SqlError(f"a trigger body cannot hold {kind}")
    engine.external.pop(TRANSITION, None)


def _insert(engine, own: Catalog, s: parser.Insert, depth: int) -> None:
    from skarn import dml

    if s.rows is not None:
        parts = []
        for r in s.rows:
            items = ", ".join(f"{parser.raw(bind(tokenize(v)))} AS c{k}" for k, v in enumerate(r))
            parts.append(f"SELECT {items} FROM {TRANSITION}")
        query = " UNION ALL ".join(parts)
    else:
        tokens = bind(tokenize(s.query))
        inner = parser.raw(tokens)
        query = f"SELECT q.* FROM {TRANSITION}, LATERAL ({inner}) q" if _mentions(tokens) else inner
    dml.apply(engine, own, parser.Insert(s.table, s.columns, None, query, s.ctes), depth + 1)


def _delete(engine, own: Catalog, s: parser.Delete, depth: int) -> None:
    from skarn import dml

    where = None
    if s.where:
        tokens = bind(tokenize(s.where))
        where = f"EXISTS (SELECT 1 FROM {TRANSITION} WHERE {parser.raw(tokens)})" if _mentions(tokens) else parser.raw(tokens)
    dml.apply(engine, own, parser.Delete(s.table, where, s.ctes), depth + 1)


def _update(engine, own: Catalog, s: parser.Update, rows: DataFrame, shown: Table, rewriter, depth: int) -> None:
    from skarn import dml

    table = own.table(s.table)
    names = table.names()
    target = engine.store.read(table, with_file=True).alias(table.name)
    to_sql = engine.rewriter([table, shown], own)
    where = parser.raw(bind(tokenize(s.where))) if s.where else "TRUE"
    pairs = target.join(rows, F.expr(to_sql.sql(where)))
    values, single = {}, False
    for name, text in s.sets:
        column = table.column(name).name
        tokens = bind(tokenize(text))
        own_tokens = [t for k, t in enumerate(tokens) if not (k >= 2 and tokens[k - 1].text == "." and tokens[k - 2].text == TRANSITION)]
        if not dml.references(own_tokens, names):
            values[column] = F.max_by(F.expr(to_sql.sql(parser.raw(tokens))), F.col("__row"))
            continue
        head = [t.text for t in tokens[:2]]
        rest_tokens = tokens[2:]
        rest_own = [t for k, t in enumerate(rest_tokens) if not (k >= 2 and rest_tokens[k - 1].text == "." and rest_tokens[k - 2].text == TRANSITION)]
        simple = not any(t.kind == "op" and t.text in "+-" for t in rest_tokens)
        if len(head) == 2 and head[0].lower() == column.lower() and head[1] in "+-" and simple and not dml.references(rest_own, names):
            total = F.sum(F.expr(to_sql.sql(parser.raw(rest_tokens))))
            first = F.first(F.col(f"`{table.name}`.`{column}`"))
            values[column] = first + total if head[1] == "+" else first - total
        else:
            values[column] = F.first(F.expr(to_sql.sql(parser.raw(tokens))))
            single = True
    olds = [F.first(F.col(f"`{table.name}`.`{c}`")).alias(f"__old_{c}") for c in names]
    news = [(values[c] if c in values else F.first(F.col(f"`{table.name}`.`{c}`"))).alias(f"__new_{c}") for c in names]
    staged = engine.store.stage(pairs.groupBy(F.col(f"`{table.name}`.{ROWID}").alias(ROWID)).agg(F.first("__file").alias("__file"), *olds, *news, F.count("*").alias("__matches")))
    if single and not staged.where("__matches > 1").isEmpty():
        raise SqlError(f"a trigger updates a row of {table.name} from several rows in a way that depends on their order")
    dml.update_rows(engine, own, table, staged.drop("__matches"), [table.column(n).name for n, _ in s.sets], depth + 1)
