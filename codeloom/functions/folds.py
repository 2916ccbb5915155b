"""Folds over the tokens of one text that give a value per token, and the bracket index built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens whose values are gathered together.  What is gathered is copied at each addition, so that it must not
#: grow with the text.
BLOCK = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chosen(needed: frozenset[str] | None, **fields: Callable[[], Column]) -> Column:
    """A struct of those fields that are needed, all if ``needed`` is None: the interpreter computes every field."""
    return F.struct(*[of().alias(name) for name, of in fields.items() if needed is None or name in needed])


def _blocked(tokens: Column, zero: Column, add: Callable, none: str, kind: str) -> Column:
    """Array of what each block of tokens has gathered: ``add`` puts a token's value to the block's."""

    def over(all_tokens: Column) -> Column:
        def block(acc: Column, at: Column) -> Column:
            start = F.struct(acc.state.alias("state"), F.expr(none).alias("out"))
            return bind(
                F.aggregate(F.slice(all_tokens, at * BLOCK + 1, BLOCK), start, add),
                lambda r: F.struct(r.state.alias("state"), F.array_append(acc.out, r.out).alias("out")),
            )

        last = F.floor((F.size(all_tokens) - 1) / BLOCK).cast("int")
        start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), start, block, lambda acc: acc.out)

    return bind(tokens, over)


def running_text(tokens: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The text that a fold leaves of its tokens; ``step(state, token)`` returns a struct of ``state`` and ``out``."""

    def add(acc: Column, token: Column) -> Column:
        return bind(
            step(acc.state, token),
            lambda r: F.struct(r.state.alias("state"), F.concat(acc.out, r.out).alias("out")),
        )

    return F.array_join(_blocked(tokens, zero, add, "''", "string"), "")


def running_rows(tokens: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The rows of SQL type ``kind`` that a fold gives, in order; ``out`` is a token's array of them, null for none."""
    rows = f"array<{kind}>"

    def add(acc: Column, token: Column) -> Column:
        return bind(
            step(acc.state, token),
            lambda r: F.struct(
                r.state.alias("state"),
                F.when(r.out.isNull(), acc.out).otherwise(F.concat(acc.out, r.out)).alias("out"),
            ),
        )

    return F.flatten(_blocked(tokens, zero, add, f"cast(array() as {rows})", rows))


# --- bracket index -------------------------------------------------------------------

#: Stand-ins for parentheses whose partner is known, and marks that a pair shares.
OPEN, CLOSE = "\x11", "\x12"
_HEIGHTS = ["\x15", "\x16", "\x17", "\x18"]
#: Private-use characters, which no code holds; one for each depth beyond the heights above.
_FIRST, _COUNT = 0xE000, 0x1900
_DEPTHS = "".join(chr(_FIRST + i) for i in range(_COUNT))
PAIR_MARK = f"[\x15-\x18{_DEPTHS[0]}-{_DEPTHS[-1]}]"


def pair_index(text: Column) -> Column:
    """``text`` whose parentheses tell their partner: both carry the same mark, which none between them has.

    Pairs that hold no others, that hold such pairs and so on are found by one pass each; in the few
    texts that nest deeper, a fold marks what is left by its depth.  Strings must be blanked before.
    """
    def marked(mark: str) -> Callable[[Column], Column]:
        pairs = f"{OPEN}{mark}$1{mark}{CLOSE}"
        return lambda t: F.when(t.contains("("), F.regexp_replace(t, r"\(([^()]*+)\)", pairs)).otherwise(t)

    for height in _HEIGHTS:
        text = bind(text, marked(height))
    return bind(text, lambda t: F.when(t.contains("("), _by_depth(t)).otherwise(t))


def _by_depth(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit("([()]|[^()]++)"))

    def mark(depth: Column) -> Column:
        return F.substring(F.lit(_DEPTHS), F.pmod(depth, F.lit(_COUNT)) + 1, F.lit(1))

    def step(depth: Column, t: Column) -> Column:
        after = F.when(t == "(", depth + 1).when(t == ")", F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        out = (
            F.when(t == "(", F.concat(F.lit(OPEN), mark(depth)))
            .when((t == ")") & (depth > 0), F.concat(mark(depth - 1), F.lit(CLOSE)))
            .otherwise(t)
        )
        return F.struct(after.alias("state"), out.alias("out"))

    return running_text(tokens, F.lit(0), step)


def pair(name: str, inside: str = "(?s:.)") -> str:
    """A pattern for a parenthesis of an indexed text up to its partner; ``inside`` is a character of it.

    The text between is the group ``<name>t``; ``<name>`` is the mark.
    """
    return rf"{OPEN}(?<{name}>{PAIR_MARK})(?<{name}t>(?>{inside}*?(?=\k<{name}>{CLOSE})))\k<{name}>{CLOSE}"


def same_pair(name: str) -> str:
    """What :func:`pair` has matched, in a replacement."""
    return f"{OPEN}${{{name}}}${{{name}t}}${{{name}}}{CLOSE}"


def plain(text: Column) -> Column:
    """Indexed text as it was."""
    return F.translate(F.regexp_replace(text, PAIR_MARK, ""), OPEN + CLOSE, "()")
