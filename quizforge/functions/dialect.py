"""Expressions that Spark SQL and DuckDB spell differently, so that a query can be stated once and checked in both."""

from __future__ import annotations


class Spark:
    name = "spark"

    def words(self, t: str) -> str:
        return f"regexp_extract_all(lower({t}), '[a-z0-9]+', 0)"

    def size(self, a: str) -> str:
        return f"size({a})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({n} AS INT))"

    def at(self, a: str, i: str) -> str:
        return f"element_at({a}, CAST({i} AS INT))"

    def join(self, a: str, sep: str = " ") -> str:
        return f"array_join({a}, '{sep}')"

    def positions(self, n: str) -> str:
        """One row for each of 1 .. n; none if n is under 1."""
        return f"explode(CASE WHEN ({n}) >= 1 THEN sequence(1, CAST(({n}) AS INT)) END)"

    def each(self, a: str) -> str:
        return f"explode({a})"

    def uniq(self, a: str) -> str:
        return f"array_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def without(self, a: str, values: list[str], longer_than: int = 0) -> str:
        out = ", ".join(f"'{v}'" for v in values)
        return f"array_distinct(filter({a}, w -> length(w) > {longer_than} AND NOT array_contains(array({out}), w)))"

    def sentences(self, t: str) -> str:
        return rf"filter(transform(split({t}, '(?<=[.!?])\\s+(?=[A-Z0-9\"\'(])'), s -> trim(s)), s -> length(s) > 15)"

    def clean(self, t: str) -> str:
        return rf"trim(regexp_replace({t}, '(?U)\\s+', ' '))"

    def sub(self, t: str, pattern: str, by: str) -> str:
        return f"regexp_replace({t}, '{self.esc(pattern)}', '{by}')"

    def esc(self, pattern: str) -> str:
        return pattern.replace("\\", "\\\\")

    def matches(self, t: str, pattern: str) -> str:
        return f"{t} rlike '{self.esc(pattern)}'"

    def extract(self, t: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({t}, '{self.esc(pattern)}', {group})"

    def hex8(self, h: str) -> str:
        return f"CAST(conv(substring({h}, 1, 8), 16, 10) AS BIGINT)"

    def field(self, j: str, name: str) -> str:
        return f"get_json_object({j}, '$.{name}')"

    def percentile(self, x: str, p: str) -> str:
        return f"percentile({x}, {p})"

    def even(self, x: str) -> str:
        return f"bround({x})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"

    def series(self, n: int) -> str:
        return f"(SELECT CAST(id AS BIGINT) AS i FROM range({n}))"

    def collect(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order}, {x}))), s -> s.{x})"

    def date_part(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')"

    def epoch(self, x: str) -> str:
        return f"unix_timestamp(CAST({x} AS TIMESTAMP))"


class Duck(Spark):
    name = "duckdb"

    def words(self, t: str) -> str:
        return f"regexp_extract_all(lower({t}), '[a-z0-9]+')"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS INT)"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"({a})[({start}):({start}) + ({n}) - 1]"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def join(self, a: str, sep: str = " ") -> str:
        return f"array_to_string({a}, '{sep}')"

    def positions(self, n: str) -> str:
        return f"unnest(range(1, CAST(({n}) AS BIGINT) + 1))"

    def each(self, a: str) -> str:
        return f"unnest({a})"

    def uniq(self, a: str) -> str:
        return f"list_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"CAST(len(list_intersect({a}, {b})) AS INT)"

    def without(self, a: str, values: list[str], longer_than: int = 0) -> str:
        out = ", ".join(f"'{v}'" for v in values)
        return f"list_distinct(list_filter({a}, lambda w: length(w) > {longer_than} AND NOT list_contains([{out}], w)))"

    def sentences(self, t: str) -> str:
        marked = rf"regexp_replace({t}, '([.!?])\s+([A-Z0-9\"''(])', '\1' || chr(1) || '\2', 'g')"
        return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: length(s) > 15)"

    def clean(self, t: str) -> str:
        return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"

    def sub(self, t: str, pattern: str, by: str) -> str:
        return f"regexp_replace({t}, '{pattern}', '{by}', 'g')"

    def esc(self, pattern: str) -> str:
        return pattern

    def matches(self, t: str, pattern: str) -> str:
        return f"regexp_matches({t}, '{pattern}')"

    def hex8(self, h: str) -> str:
        return f"CAST('0x' || substring({h}, 1, 8) AS BIGINT)"

    def field(self, j: str, name: str) -> str:
        return f"json_extract_string({j}, '$.{name}')"

    def percentile(self, x: str, p: str) -> str:
        return f"quantile_cont({x}, {p})"

    def even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def series(self, n: int) -> str:
        return f"(SELECT i FROM range({n}) t(i))"

    def collect(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def date_part(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')"

    def epoch(self, x: str) -> str:
        return f"CAST(epoch({x}) AS BIGINT)"
