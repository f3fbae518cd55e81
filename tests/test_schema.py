"""The schema language."""

import pytest

from tesserae.operators import schema as S

TEXT = """{$}
id = "policy"

{@person}
name = !:(1..20)
home = @address
{@address}
zip = :format zip
{policy}
number = !:/^P\\d+$/
holder = !@person
kind = (auto, home)
premium = !#$:(0..1000)
end = date :if kind = auto
:invariant premium > 10
:at_most_one kind, end
{rows[]} :(1..5) :unique
sku = !
count = ##:(1..)
"""


def test_parse():
    s = S.parse(TEXT)
    rules = {f.path: f for f in s.resolved().fields}
    assert s.metadata == {"id": "policy"} and s.uses == {"policy.holder": "person"} and not s.circular and not s.unresolved
    assert rules["policy.holder.name"].required and rules["policy.holder.name"].maximum == 20 and rules["policy.holder.home.zip"].format == "zip"
    assert rules["policy.number"].pattern == "^P\\d+$" and rules["policy.kind"].enum == ("auto", "home") and rules["policy.premium"].type == "currency"
    assert rules["policy.end"].condition == ("kind", "=", "auto", False) and rules["rows[].count"].minimum == 1
    assert s.rules.invariants == [("policy", "premium", ">", 10)] and s.rules.cardinalities == [("policy", ("kind", "end"), None, 1)]
    [rows] = s.rules.arrays
    assert (rows.minimum, rows.maximum, rows.unique) == (1, 5, True)


def test_serialise_round_trip():
    once = S.parse(TEXT)
    again = S.parse(S.serialise(once))
    key = lambda s: sorted(map(repr, s.resolved().fields)) + sorted(map(repr, s.rules.arrays + s.rules.invariants + s.rules.cardinalities))
    assert key(once) == key(again) and once.types.keys() == again.types.keys()


def test_imports(tmp_path):
    (tmp_path / "a.s").write_text('@import "b.s" as b\n{x}\nf = !##\n')
    (tmp_path / "b.s").write_text("{@t}\nq = ?\n{x}\nf = string\ng = @t\n")
    s = S.load(str(tmp_path / "a.s"))
    assert {f.path: f.type for f in s.rules.fields} == {"x.f": "integer"} and "b.t" in s.types and s.unresolved == []
    (tmp_path / "b.s").write_text('@import "a.s"\n')
    with pytest.raises(ValueError, match="circular"):
        S.load(str(tmp_path / "a.s"))


def test_circular_types():
    assert S.parse("{@a}\nb = @b\n{@b}\na = @a\n").circular == ["a", "b"]
    assert S.parse("{x}\ny = @nothing\n").unresolved == ["nothing"]
