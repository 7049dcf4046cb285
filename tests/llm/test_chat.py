import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from cohortvox.llm import chat as C


def show(source, **env):
    return "".join(t for t, _ in C.compile_template(source)(env))


@pytest.mark.parametrize("source, env, want", [
    ("a{{ 1 + 2 }}b", {}, "a3b"),
    ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1p, 2q"),
    ("  {%- if a == 'x' and b -%} yes {%- elif b %} maybe{% else %} no{% endif %}", {"a": "x", "b": 1}, "yes"),
    ("{% set n = m['k'] %}{{ n | upper ~ '}}' }}{# gone #}", {"m": {"k": "v"}}, "V}}"),
    ("{{ 'a' if 'x' in s else 'b' }}{{ none }}{{ true }}", {"s": "xyz"}, "atrue"),
    ("{{ missing.deep.er }}{{ l[0] }}{{ l[9] }}", {"l": [5]}, "5"),
    ('{{ "q\\"\\n" }}', {}, 'q"\n'),
])
def test_language(source, env, want):
    assert show(source, **env) == want


def test_constants_fold():
    assert C.fold(C.parse("x{{ 'a' ~ 1 }}y{% if 1 == 2 %}z{% else %}w{% endif %}")) == ("block", [("out", ("value", "xa1yw"))])


@pytest.mark.parametrize("source", ["{{ a", "{% if a %}", "{% endfor %}", "{{ a.b() }}", "{{ a | nope }}", "{{ 1 + }}", "{% while a %}", "{{ 'a' + 1 }}"])
def test_errors(source):
    with pytest.raises(C.TemplateError):
        show(source, a="x")


def test_sandbox():
    assert show("{{ a.__class__ }}{{ a['__class__'] }}", a="x") == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*C.CONTROLS, "\\", "<", "[", "|", "a", "</", "é", "\n", "<|", "[/"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_controls(t):
    e = C.escape(t)
    assert C.unescape(e) == t and not any(c in e for c in C.CONTROLS)


def brute(turns):
    convs = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [40, 10**6])
def test_round_trip(spark, part):
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice([*C.CONTROLS, "\\", "<", "ok", " ", "é", "\n"]) for _ in range(rnd.randrange(8)))
    turns = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|body|>"]), rnd.choice([text(), None])) for c in range(40) for t in range(rnd.randrange(1, 9))]
    turns += [(50, t % 700, "user", f"t{t}") for t in range(1500)] + [(None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 0, "user", "dup"), (3, 0, "user", "dup")]
    df = spark.createDataFrame([(*r, 1) for r in turns], "conv_id long, turn long, role string, text string, part int").repartition(4)
    f = C.format_conversations(df, part_chars=part)
    for got in (C.read_back(f, clustered=True).collect(), C.read_back(f.repartition(3)).collect()):
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(turns)
        assert len(got) == len(brute(turns))
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0
