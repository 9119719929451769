"""SQL of the shard query: 64-bit hashes, checksums and the permutation written out in arithmetic."""

from __future__ import annotations

from .shard import ROUNDS

#: The primes of the 64-bit xxHash algorithm.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
TWO_64 = "18446744073709551616::UHUGEINT"


def wrapped(expression: str) -> str:
    return f"(({expression}) % {TWO_64})::UBIGINT"


def times(a: str, c: int) -> str:
    return wrapped(f"({a})::UHUGEINT * {c}::UHUGEINT")


def plus(a: str, c: int) -> str:
    return wrapped(f"({a})::UHUGEINT + {c}::UHUGEINT")


class Columns:
    """Column definitions that build on each other, each computed once in a query of its own."""

    def __init__(self) -> None:
        self.made: list[str] = []

    def let(self, expression: str) -> str:
        name = f"t{len(self.made)}"
        self.made.append(f"{expression} AS {name}")
        return name

    def over(self, source: str) -> str:
        """``source`` with all the columns."""
        for column in self.made:
            source = f"(SELECT *, {column} FROM {source})"
        return source

    def turned(self, a: str, bits: int) -> str:
        return self.let(f"xor({times(a, 1 << bits)}, {a} >> {64 - bits})")

    def mixed(self, h: str) -> str:
        h = self.let(times(self.let(f"xor({h}, {h} >> 33)"), P2))
        h = self.let(times(self.let(f"xor({h}, {h} >> 29)"), P3))
        return self.let(f"xor({h}, {h} >> 32)")

    def hash_long(self, value: str, seed: str) -> str:
        k = self.let(times(self.turned(self.let(times(f"({value})::UBIGINT", P2)), 31), P1))
        h = self.turned(self.let(f"xor({plus(seed, P5 + 8)}, {k})"), 27)
        return self.let(f"coalesce({self.mixed(self.let(plus(times(h, P1), P4)))}, {seed})")

    def hash_int(self, value: int, seed: str) -> str:
        h = self.turned(self.let(f"xor({plus(seed, P5 + 4)}, {times(str(value), P1)})"), 23)
        return self.mixed(self.let(plus(times(h, P2), P3)))

    def residue(self, h: str, modulus: str) -> str:
        """Of the hash as a signed number, not negative."""
        signed = f"(CASE WHEN {h} >= 9223372036854775808 THEN {h}::HUGEINT - 18446744073709551616 ELSE {h}::HUGEINT END)"
        return f"(({signed} % {modulus} + {modulus}) % {modulus})"


def step_sql(source: str, seed: int) -> str:
    """One step of the permutation for ``source`` (row, x, a, b, n)."""
    c = Columns()
    left, right = c.let("(x // b)::HUGEINT"), c.let("(x % b)::HUGEINT")
    for i in range(ROUNDS):
        half, modulus = (right, "a") if i % 2 == 0 else (left, "b")
        h = c.hash_int(seed, c.hash_int(i, c.hash_long(half, "42::UBIGINT")))
        if i % 2 == 0:
            left = c.let(f"({left} + {c.residue(h, modulus)}) % a")
        else:
            right = c.let(f"({right} + {c.residue(h, modulus)}) % b")
    return f"SELECT row, ({left} * b + {right})::BIGINT AS y, a, b, n FROM {c.over(source)}"


def oracle_sql(shards: int = 8, seed: int = 17, buckets: int = 8192) -> str:
    c = Columns()
    h = c.hash_long("size", c.hash_long("text_crc32", c.hash_long("doc_id", "42::UBIGINT")))
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32 FROM documents, tab),
k AS (SELECT doc_id, size, text_crc32, ({h} % {buckets})::BIGINT AS bucket FROM {c.over('d')}),
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM k),
s AS (SELECT row, row AS x, (CASE WHEN n = 1 THEN 1 ELSE floor(sqrt((n - 1)::DOUBLE)) + 1 END)::BIGINT AS a, n FROM r),
w AS ({step_sql('(SELECT *, ((n + a - 1) // a)::BIGINT AS b FROM s)', seed)}
  UNION ALL {step_sql('(SELECT row, y AS x, a, b, n FROM w WHERE y >= n)', seed)})
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {shards})::INT AS shard, (y // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, row, y AS place FROM r JOIN w USING (row, n) WHERE y < n"""
