"""Building blocks of the ANSI-SQL statements that results are checked against."""

from __future__ import annotations

from pingtrail.functions.fixed import BEARING_OFFSETS, NODE_LABELS
from pingtrail.plans.adapters import NODES, VIEWS


def _values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{v!r}e0"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def table(name: str) -> str:
    """Common table expression of an adapted table."""
    query, columns = VIEWS[name]
    picked = ", ".join(f'{sql} AS "{c}"' for c, sql in columns.items())
    return f"{name} AS (SELECT {picked} FROM ({query}) AS src)"


OFFSETS = (
    "bearing_offsets AS (SELECT * FROM (VALUES "
    + _values(BEARING_OFFSETS) + ") AS o(recvDeployName, off))"
)
LABELS = "node_labels AS (SELECT * FROM (VALUES " + _values(NODE_LABELS) + ") AS l(NodeId, label))"
NODES_CTE = (
    "nodes AS (SELECT * FROM (VALUES "
    + _values([(n.lower(), lat, lng) for n, lat, lng in NODES]) + ") AS n(NodeId, lat, lng))"
)


def query(*ctes: str, body: str) -> str:
    parts = [table(c) if c in VIEWS else c for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def r6(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0 AS {name}"


def wrap360(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def solar_day(ts: str, lon: str) -> str:
    return (
        f"CAST(make_timestamp(epoch_us({ts}) + CAST(floor({lon} * 240000000e0 + 0.5e0)"
        " AS BIGINT)) AS DATE)"
    )


def sun(source: str, day: str, lat: str, lon: str, wanted: dict[str, tuple[float, int]]) -> str:
    """Select from ``source`` with the wanted sun times (name -> altitude, side) in epoch
    microseconds, following the published equations step by step."""
    events = ", ".join(
        f"""CAST(round((ds + eq {'+' if side > 0 else '-'}
            CASE WHEN abs((sin({h}e0 * pi() / 180) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec)))
                <= 1 THEN acos((sin({h}e0 * pi() / 180) - sin(phi) * sin(dec))
                / (cos(phi) * cos(dec))) END / (2 * pi()) + 10957.5e0)
            * 86400 * 1000000) AS BIGINT) AS {name}"""
        for name, (h, side) in wanted.items()
    )
    hidden = "lw, phi, n_, ds, m, l_, dec, eq"
    return f"""SELECT * EXCLUDE ({hidden}), {events} FROM (
        SELECT *, asin(sin(23.4397e0 * pi() / 180) * sin(l_)) AS dec,
            0.0053e0 * sin(m) - 0.0069e0 * sin(2 * l_) AS eq FROM (
        SELECT *, m + (1.9148e0 * sin(m) + 0.02e0 * sin(2 * m) + 0.0003e0 * sin(3 * m))
            * pi() / 180 + 102.9372e0 * pi() / 180 + pi() AS l_ FROM (
        SELECT *, (357.5291e0 + 0.98560028e0 * ds) * pi() / 180 AS m FROM (
        SELECT *, 0.0009e0 + lw / (2 * pi()) + n_ AS ds FROM (
        SELECT *, floor(datediff('day', DATE '1970-01-01', {day}) + 2440588 - 2451545
            - 0.0009e0 - lw / (2 * pi()) + 0.5e0) AS n_ FROM (
        SELECT *, -({lon}) * pi() / 180 AS lw, ({lat}) * pi() / 180 AS phi FROM {source}))))))"""
