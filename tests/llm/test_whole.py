"""Inputs on which an operator once did less than the whole job."""

import numpy as np
import pytest

from rankfit.llm import op4_packing as O4, op6_html as O6


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers

    words = O4.Words(public_tokenizers.path(O4.TOKENIZER))
    texts = [s for n in range(1, 0x250) for c in [chr(n)] for s in (c, f"m{c}", f"{c}m", f"M{c}M.", f"km{c}, {c}{c}; x")]
    texts += ["<|ENDOFTEXT|>", "<|endoftext|>", "a<|EndOfText|>b C", "<|STARTOFTEXT|> <|startoftext|>", "<| A|>"]
    texts += [f"{c}{mark}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for mark in map(chr, range(0x300, 0x370))] + ["J\u030cA b", "T\u0344"]
    for given in (texts, texts):  # the second time from the cache
        for text, got in zip(given, words.ids(given)):
            assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def _text(page):
    return O6.Model.fixed().extract([page])[0]


A, B = "The first paragraph of the story, long enough to count.", "The second paragraph comes later, and it counts as well."


@pytest.mark.parametrize("tag", ["script", "style", "title", "svg", "noscript", "iframe", "textarea", "SCRIPT"])
def test_text_after_a_closed_element(tag):
    page = f"<article><p>{A}</p><p>{'İ' * 9} is a letter, and a rather frequent one.</p><{tag}>var x = 1 < 2;</{tag}>{B}<p>{B}</p></article>"
    assert _text(page).split("\n\n") == [A, "İİİİİİİİİ is a letter, and a rather frequent one.", B, B]


def test_only_the_own_end_ends_a_script():
    page = f"<article><p>{A}</p><script>'</scrİpt></scriptx></ſcript>'</ScRiPt\n><p>{B}</p></article>"
    assert _text(page).split("\n\n") == [A, B]


@pytest.mark.parametrize("tag", ["svg", "math", "object", "noscript", "template", "noframes"])
def test_text_after_an_unclosed_element(tag):
    for page in (f"<article><p>{A}</p><{tag} class=x><p>{B}</p>{B}</article>", f"<article><p>{A}<{tag}></p>{B}<p>{B}</p></article>"):
        assert _text(page).split("\n\n") == [A, B, B], page


def test_text_after_graphics_closed_too_late():
    page = f"<article><p>{A}<a href=x><svg><path d='M0'></a></p>{B}<p>{B}</p><svg><path d='M1'/></svg></article>"
    assert _text(page).split("\n\n") == [A, B, B]


def test_formulas_and_objects_are_text():
    page = f"<article><p>{A} Here <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds.</p><object data=y><p>{B}</p></object></article>"
    assert _text(page).split("\n\n") == [f"{A} Here x=2 holds.", B]
    assert B not in _text(f"<article><p>{A}</p><svg><g><text>{B}</text></g></svg><noscript>{B}</noscript></article>")
