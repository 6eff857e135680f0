"""License keywords against generated matches of every branch of every rule."""

from itertools import product
from re import _constants as kinds
from re import _parser as parser

import pytest

from hearthline.llm import licenses


def expression(rule: licenses.Rule) -> str:
    return rule.pattern.pattern.decode().removeprefix("(?<= )(?:").removesuffix(")(?= )")


def matches(parsed) -> list[str]:
    """Each branch, and each optional part with and without."""
    parts = []
    for kind, value in parsed:
        if kind is kinds.LITERAL:
            parts.append([chr(value)])
        elif kind is kinds.ANY:
            parts.append(["q"])
        elif kind is kinds.IN:
            first, what = value[0]
            parts.append([chr(what if first is kinds.LITERAL else what[0])])
        elif kind is kinds.SUBPATTERN:
            parts.append(matches(value[-1]))
        elif kind is kinds.BRANCH:
            parts.append([x for one in value[1] for x in matches(one)])
        else:
            assert kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT)
            least, most, inner = value
            parts.append([x * n for n in {least, min(most, least + 1)} for x in matches(inner)])
    return ["".join(x) for x in product(*parts)]


def test_every_generated_match_holds_its_keyword():
    for rule in licenses.RULES:
        for text in matches(parser.parse(expression(rule))):
            assert rule.pattern.search(f" {text} ".encode()), (rule.name, text)
            assert rule.keyword.decode() in f" {text} ", (rule.name, text)


@pytest.mark.parametrize("what", ["AI", "machine learning", "language"])
@pytest.mark.parametrize("how", ["to train", "for training", "for training of"])
def test_no_ai_training_is_found_by_each_branch(how, what):
    assert [d.label for d in licenses.scan(f"This text may not be used {how} {what} models.")[2]] == ["no-ai-training"]
