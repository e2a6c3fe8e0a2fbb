"""Keyed pseudorandom permutations of 0..n-1 as plain SQL expressions, in Spark's and DuckDB's dialects."""

from __future__ import annotations

#: Feistel rounds, and the most steps a walk may take. A walk leaves the domain with probability
#: below 1/sqrt(n) a step, and at most sqrt(n) points lie outside, so 64 steps always do in practice;
#: a longer walk raises an error instead of giving a wrong value.
ROUNDS, WALK = 4, 64


def digest(*parts: str) -> str:
    """Spark SQL: 60 bits of an MD5, as a non-negative bigint."""
    return f"CAST(conv(substring(md5(concat_ws('|', {', '.join(f'CAST({p} AS STRING)' for p in parts)})), 1, 15), 16, 10) AS BIGINT)"


def digest_duck(*parts: str) -> str:
    """The same in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15) AS BIGINT)"


def sides(n: str) -> tuple[str, str]:
    """The two digits' bases: a * b is n or a little more."""
    a = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"
    return a, f"(({n} + {a} - 1) DIV {a})"


def permuted(x: str, n: str, key: str, a: str, b: str) -> str:
    """Spark SQL: the place of x (0 to n-1) under the permutation that key names. a and b: columns made by sides(n)."""
    once = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', v DIV {b}, 'r', v % {b}), "
        f"(s, i) -> IF(i % 2 = 0, named_struct('l', (s.l + {digest(key, 'i', 's.r')}) % {a}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {digest(key, 'i', 's.l')}) % {b})), s -> s.l * {b} + s.r)"
    )
    return (
        f"aggregate(sequence(0, {WALK}), CAST({x} AS BIGINT), (v, k) -> IF(k > 0 AND v < {n}, v, {once}), "
        f"v -> IF(v < {n}, v, CAST(raise_error('the walk did not end') AS BIGINT)))"
    )


def permuted_duck(rows: str, keep: str, x: str, n: str, key: str) -> str:
    """DuckDB: a parenthesised query giving `keep` and `place` for each row of `rows` (x and n must be among keep)."""
    a = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"

    def walk(source: str, where: str) -> str:
        q = f"SELECT {keep}, {a} AS fa, ({n} + {a} - 1) // {a} AS fb, v FROM {source} {where}"
        q = f"SELECT {keep}, fa, fb, v // fb AS l, v % fb AS r FROM ({q})"
        for i in range(ROUNDS):
            step = f"(l + {digest_duck(key, str(i), 'r')}) % fa AS l, r" if i % 2 == 0 else f"l, (r + {digest_duck(key, str(i), 'l')}) % fb AS r"
            q = f"SELECT {keep}, fa, fb, {step} FROM ({q})"
        return f"SELECT {keep}, l * fb + r AS v FROM ({q})"

    return (
        f"(WITH RECURSIVE walked AS ({walk(f'(SELECT {keep}, CAST({x} AS BIGINT) AS v FROM {rows})', '')} "
        f"UNION ALL {walk('walked', f'WHERE v >= {n}')}) SELECT {keep}, v AS place FROM walked WHERE v < {n})"
    )
