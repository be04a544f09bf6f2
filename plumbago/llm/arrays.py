"""SQL expressions over the spans of one text, none of them quadratic in their number: running totals, overlaps joined, texts put together again."""

from __future__ import annotations

#: Code points of the blocks that a text is put together from.
PIECE = 1024


def let(name: str, value: str, body: str) -> str:
    """SQL for a body in which a name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(x: str, step: str = "p + q", zero: str = "0") -> str:
    """SQL for running totals of an array of integers (or running maxima): after k steps every element holds what the 2**k up to it give."""
    shifted = f"concat(array_repeat({zero}, shiftleft(1, k)), slice(a, 1, size(a) - shiftleft(1, k)))"
    return let("x", x, f"aggregate(filter(sequence(0, 30), k -> shiftleft(1, k) < size(x)), x, (a, k) -> zip_with(a, {shifted}, (p, q) -> {step}))")


def apart(spans: str) -> str:
    """SQL for spans (start, end, kind) in order, those that overlap joined and named after the first: a span begins a new one if none before it reaches its start."""
    upto = running("transform(s, y -> y.end)", "greatest(p, q)")
    firsts = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].start >= m[i - 1])"
    joined = "transform(f, (i, j) -> named_struct('start', s[i].start, 'end', m[if(j + 1 < size(f), f[j + 1], size(s)) - 1], 'kind', s[i].kind))"
    return f"if(size({spans}) > 0, {let('s', f'array_sort({spans})', let('m', upto, let('f', firsts, joined)))}, cast(array() as array<struct<start:int,end:int,kind:string>>))"


def replaced(text: str, spans: str, mark: str) -> str:
    """SQL for a text with ``mark`` (of a span s) in the place of each of its spans, which are apart, in order and at least one."""
    cut = f"""if(o.a >= o.b, '', if(o.a div {PIECE} = (o.b - 1) div {PIECE}, substring(c[cast(o.a div {PIECE} as int)], o.a % {PIECE} + 1, o.b - o.a),
      concat(substring(c[cast(o.a div {PIECE} as int)], o.a % {PIECE} + 1), array_join(slice(c, cast(o.a div {PIECE} as int) + 2, cast((o.b - 1) div {PIECE} - o.a div {PIECE} as int) - 1), ''), substring(c[cast((o.b - 1) div {PIECE} as int)], 1, (o.b - 1) % {PIECE} + 1))))"""
    between = f"""concat(transform({spans}, (s, i) -> named_struct('a', if(i = 0, 0, get({spans}, i - 1).end), 'b', s.start, 'mark', {mark})),
      array(named_struct('a', element_at({spans}, -1).end, 'b', length({text}), 'mark', '')))"""
    return let("c", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", f"array_join(transform({between}, o -> concat({cut}, o.mark)), '')")
