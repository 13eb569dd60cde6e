"""Two-dimensional boxes: predicates, measures, range search, nearest boxes and
a box join, as column arithmetic that Spark pushes down and compiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import relational


@dataclass(frozen=True)
class Box:
    """A box of column expressions or numbers."""

    min_x: Column
    max_x: Column
    min_y: Column
    max_y: Column

    @classmethod
    def of(cls, min_x, max_x, min_y, max_y) -> Box:
        lift = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
        return cls(*map(lift, (min_x, max_x, min_y, max_y)))

    def intersects(self, o: Box) -> Column:
        return (self.min_x <= o.max_x) & (self.max_x >= o.min_x) & (self.min_y <= o.max_y) & (self.max_y >= o.min_y)

    def contains_point(self, x, y) -> Column:
        return (self.min_x <= x) & (self.max_x >= x) & (self.min_y <= y) & (self.max_y >= y)

    def contains(self, o: Box) -> Column:
        return (self.min_x <= o.min_x) & (self.max_x >= o.max_x) & (self.min_y <= o.min_y) & (self.max_y >= o.max_y)

    def area(self) -> Column:
        return (self.max_x - self.min_x) * (self.max_y - self.min_y)

    def combine(self, o: Box) -> Box:
        return Box(F.least(self.min_x, o.min_x), F.greatest(self.max_x, o.max_x), F.least(self.min_y, o.min_y), F.greatest(self.max_y, o.max_y))

    def expanded_area(self, o: Box) -> Column:
        """How much the area grows when o is taken in."""
        return self.combine(o).area() - self.area()

    def center(self) -> tuple[Column, Column]:
        return (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2

    def distance_to_point(self, x, y) -> Column:
        dx = F.greatest(self.min_x - x, F.lit(0.0), F.lit(x) - self.max_x)
        dy = F.greatest(self.min_y - y, F.lit(0.0), F.lit(y) - self.max_y)
        return F.sqrt(dx * dx + dy * dy)


def search_range(df: DataFrame, box: Box, query: Box) -> DataFrame:
    """Rows whose box meets the query box."""
    return df.where(box.intersects(query))


def nearest(df: DataFrame, box: Box, x: float, y: float, k: int, key: str) -> DataFrame:
    """The k rows whose boxes are nearest to a point."""
    return df.withColumn("distance", box.distance_to_point(F.lit(float(x)), F.lit(float(y)))).orderBy("distance", key).limit(k)


def box_join(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, cell: float) -> DataFrame:
    """Pairs of rows whose boxes meet, as an equality join of grid cells.

    Grid l has cells of cell * 2^l.  A box belongs to the finest grid in which it
    spans few cells, and is dealt to the cells it touches there and in all coarser
    grids that some box belongs to; so it has a few cells for each grid, however
    large it is.  Two boxes meet in the coarser of their own grids, and are
    reported in the one cell there that holds the lower corner of the common
    part.  `cell` should be about the size of a small box."""
    corners = ("min_x", "max_x", "min_y", "max_y")
    sized = []
    for df, b, side in ((left, left_box, "l"), (right, right_box, "r")):
        df = df.withColumns({f"__{side}{n}": getattr(b, n).cast("double") for n in corners})
        wide = F.greatest(F.col(f"__{side}max_x") - F.col(f"__{side}min_x"), F.col(f"__{side}max_y") - F.col(f"__{side}min_y"))
        sized.append(df.withColumn(f"__{side}own", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide, F.lit(cell)) / cell))).cast("int")))
    # As many numbers as there are grids: the logarithm of the widest box.
    grids = sorted(r[0] for r in sized[0].select("__lown").unionAll(sized[1].select("__rown")).distinct().dropna().collect())

    def dealt(df: DataFrame, side: str) -> DataFrame:
        df = df.withColumn("__grid", F.explode(F.filter(F.array(*map(F.lit, grids)).cast("array<int>"), lambda g: g >= F.col(f"__{side}own"))))
        for axis in "xy":
            low, high = (_cell(F.col(f"__{side}{end}_{axis}"), F.col("__grid"), cell) for end in ("min", "max"))
            df = df.withColumn(f"__{side}first_{axis}", low).withColumn(f"__c{axis}", F.explode(F.sequence(low, high)))
            # The common part's lower corner is in a cell both touch if one of them starts there.
            df = df.withColumn(f"__{side}first_{axis}", F.col(f"__{side}first_{axis}") == F.col(f"__c{axis}"))
        return df

    pairs = relational.dealt_join(*(dealt(df, side) for df, side in zip(sized, "lr")), ["__grid", "__cx", "__cy"])
    la, rb = (Box.of(*[f"__{side}{n}" for n in corners]) for side in "lr")
    corner = [F.col(f"__lfirst_{x}") | F.col(f"__rfirst_{x}") for x in "xy"]
    out = pairs.where(corner[0] & corner[1] & la.intersects(rb) & (F.greatest("__lown", "__rown") == F.col("__grid")))
    return out.drop("__grid", "__cx", "__cy", *[c for c in out.columns if c.startswith(("__l", "__r"))])


def _cell(value: Column, grid: Column, cell: float) -> Column:
    return F.floor(value / (F.lit(cell) * F.pow(F.lit(2.0), grid))).cast("long")


_BOX = "(a0 DOUBLE, a1 DOUBLE, a2 DOUBLE, a3 DOUBLE"
_OTHER = ", b0 DOUBLE, b1 DOUBLE, b2 DOUBLE, b3 DOUBLE"
#: SQL forms over min_x, max_x, min_y, max_y, expanded by the dialect.
SQL_FUNCTIONS = {
    "bbox_intersects": f"{_BOX}{_OTHER}) RETURNS BOOLEAN RETURN a0 <= b1 AND a1 >= b0 AND a2 <= b3 AND a3 >= b2",
    "bbox_contains": f"{_BOX}{_OTHER}) RETURNS BOOLEAN RETURN a0 <= b0 AND a1 >= b1 AND a2 <= b2 AND a3 >= b3",
    "bbox_contains_point": f"{_BOX}, x DOUBLE, y DOUBLE) RETURNS BOOLEAN RETURN a0 <= x AND a1 >= x AND a2 <= y AND a3 >= y",
    "bbox_area": f"{_BOX}) RETURNS DOUBLE RETURN (a1 - a0) * (a3 - a2)",
    "bbox_distance": f"{_BOX}, x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN sqrt(power(greatest(a0 - x, 0D, x - a1), 2) + power(greatest(a2 - y, 0D, y - a3), 2))",
}
