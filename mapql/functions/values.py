"""Expressions of the query language as columns. Values are strings; two compare as numbers if both are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapql.functions import geo
from mapql.ql import syntax as s

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(v: Column) -> Column:
    """A value as a double, null if it isn't one."""
    return F.when(F.trim(v).rlike(NUMBER), F.trim(v).try_cast("double"))


def text(v: Column) -> Column:
    """A double as a value: whole numbers without a fraction, nothing as ``nan``."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(v.isNull() | F.isnan(v), F.lit("nan")).when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def truthy(v: Column) -> Column:
    return (v != "") & (v != "0")


def _flag(c: Column) -> Column:
    return F.when(c, "1").otherwise("0")


def _plain(v: object) -> str:
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def binary(op: str, a: Column, b: Column) -> Column:
    x, y = number(a), number(b)
    if op in ("&&", "||"):
        return _flag(truthy(a) & truthy(b) if op == "&&" else truthy(a) | truthy(b))
    if op in "+-*/":
        return text({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / y)}[op]())
    both = x.isNotNull() & y.isNotNull()
    compare = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    return _flag(F.when(both, compare(x, y)).otherwise(compare(a, b)))


def element(node: object) -> Column:  # noqa: C901, PLR0911
    """An expression over one element, as a string column."""
    if isinstance(node, s.Literal):
        return F.lit(_plain(node.value))
    if isinstance(node, s.Tag):
        return F.coalesce(F.col("tags")[element(node.key)], F.lit(""))
    if isinstance(node, s.Binary):
        return binary(node.op, element(node.left), element(node.right))
    if isinstance(node, s.Unary):
        v = element(node.value)
        return _flag(~truthy(v)) if node.op == "!" else text(-number(v))
    if isinstance(node, s.Ternary):
        return F.when(truthy(element(node.condition)), element(node.then)).otherwise(element(node.otherwise))
    if node.name in s.SET_CALLS:
        raise s.UnsupportedError(f"{node.name}() needs a set, not an element")
    refs, members = F.col("refs"), F.col("members")
    is_way = F.col("type") == "way"
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if node.name in ("id", "type", "version", "changeset", "uid", "user"):
        return blank(node.name)
    if node.name == "timestamp":
        return F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    if node.name == "count_tags":
        return F.coalesce(F.size(F.map_keys("tags")), F.lit(0)).cast("string")
    if node.name == "count_members":
        return F.when(is_way, size(refs)).otherwise(size(members))
    if node.name == "count_distinct_members":
        return F.when(is_way, size(F.array_distinct(refs))).otherwise(size(F.array_distinct(F.transform(members, lambda m: F.concat_ws(":", m["type"], m["ref"])))))
    if node.name == "count_by_role":
        role = element(node.args[0])
        return size(F.filter(members, lambda m: m["role"] == role))
    if node.name == "is_closed":
        return _flag(F.coalesce(is_way & (F.size(refs) >= 2) & (F.try_element_at(refs, F.lit(1)) == F.try_element_at(refs, F.lit(-1))), F.lit(False)))
    if node.name == "length":
        return text(geo.length(F.col("geometry")))
    if node.name in ("lat", "lon"):
        return text(F.when(F.col("type") == "node", F.col(f"{node.name}_e7") / geo.E7))
    if node.name == "is_tag":
        if not isinstance(node.args[0], s.Literal):
            raise s.UnsupportedError("is_tag() needs a literal key")
        return _flag(F.coalesce(F.col("tags")[element(node.args[0])].isNotNull(), F.lit(False)))
    value = element(node.args[0])
    return text(number(value)) if node.name == "number" else _flag(number(value).isNotNull())


#: Letters of the kinds that count() takes.
KINDS = {"nodes": ["node"], "ways": ["way"], "relations": ["relation"], "areas": ["area"], "nwr": ["node", "way", "relation"], "nw": ["node", "way"], "nr": ["node", "relation"], "wr": ["way", "relation"]}


def aggregate(call: s.Call) -> Column:
    """A function of a set as an aggregate over its rows."""
    if call.name == "count":
        return F.count_if(F.col("type").isin(KINDS[call.args[0].value])).cast("string")
    v = element(call.args[0])
    if call.name == "u":
        return F.when(F.count_distinct(v) == 1, F.max(v)).otherwise(F.lit(""))
    if call.name == "set":
        return F.array_join(F.array_sort(F.collect_set(v)), ", ")
    x = {"min": F.min, "max": F.max, "sum": F.sum}[call.name](number(v))
    return text(F.coalesce(x, F.lit(0.0)) if call.name == "sum" else x)


def of_sets(node: object, find) -> str:  # noqa: ANN001
    """An expression over sets: one job for each set, with all its aggregates."""
    calls: list[s.Call] = []

    def walk(n: object) -> None:
        if isinstance(n, s.Call):
            if n.name in s.SET_CALLS:
                calls.append(n)
                return
            if n.name not in ("number", "is_number"):
                raise s.RuntimeQueryError(f"{n.name}() needs an element")
        if isinstance(n, s.Tag):
            raise s.RuntimeQueryError("t[] needs an element")
        for v in vars(n).values() if hasattr(n, "__dict__") else ():
            for part in v if isinstance(v, list) else [v]:
                if hasattr(part, "__dict__"):
                    walk(part)

    walk(node)
    known: dict[int, str] = {}
    for name in {c.source for c in calls}:
        own = [c for c in calls if c.source == name]
        row = find(name).agg(*[aggregate(c).alias(f"c{i}") for i, c in enumerate(own)]).first()
        known.update({id(c): row[i] for i, c in enumerate(own)})

    def put(n: object) -> object:
        if id(n) in known:
            return s.Literal(known[id(n)])
        if isinstance(n, s.Binary):
            return s.Binary(n.op, put(n.left), put(n.right))
        if isinstance(n, s.Unary):
            return s.Unary(n.op, put(n.value))
        if isinstance(n, s.Ternary):
            return s.Ternary(put(n.condition), put(n.then), put(n.otherwise))
        return s.Call(n.name, [put(a) for a in n.args], n.source) if isinstance(n, s.Call) else n

    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(1).select(element(put(node)).alias("v")).first()["v"]


def of_rows(df: DataFrame, expression: str, name: str = "value") -> DataFrame:
    return df.withColumn(name, element(s.parse_expression(expression)))
