"""Texts that are not R are not made into tokens whole, and their errors stay those of the whole text."""

import pytest

from surfacescan.operators import rsyntax

PROSE = "some words, that are no program. " * 3_000


@pytest.fixture
def made(monkeypatch):
    count = [0]

    class Counted(rsyntax.Token):
        def __init__(self, *args):
            count[0] += 1
            super().__init__(*args)

    monkeypatch.setattr(rsyntax, "Token", Counted)
    return count


@pytest.mark.parametrize(("text", "says"), [
    (PROSE, "unexpected 'words' at line 1"), (PROSE + "\n'open", "unexpected input at line 2"), (PROSE + "r'(\n)' 'a\n' \u20ac", "unexpected input at line 3"),
    (PROSE + "\n\nR'--[ ]-'", "unterminated raw string at line 3"), ("(" * 5_000, "nested too deeply"), ("(" * 5_000 + "\u20ac", "unexpected input at line 1"),
])
def test_few_tokens_are_made(made, text, says):
    with pytest.raises(rsyntax.RSyntaxError) as e:
        rsyntax.parse(text)
    assert str(e.value) == says and made[0] < 2_500


def test_long_programs_are_whole():
    for n in (1, 7, 8, 9, 63, 64, 65, 1_000):
        nodes = list(rsyntax.rows(rsyntax.parse("f(x)\n" * n)))
        assert sum(x[6] == "SYMBOL_FUNCTION_CALL" for x in nodes) == n and nodes[-1][8] == n
