"""Wrappers hold every child of a node: constants beyond the two-hundredth are the template's too."""

from tessera.llm import wrapper


def test_constants_beyond_the_two_hundredth_go():
    pages = []
    for k in range(5):
        lines = "".join(f"<div class='line{chr(97 + i // 26)}{chr(97 + i % 26)}'><b>Constant line {i}</b></div>" for i in range(260))
        pages.append(f"<html><body>{lines}<div class='zz'><p>{' '.join(f'own{k}x{j}' for j in range(400))}</p></div></body></html>")
    one = wrapper.expression(pages[0])
    for p in pages[1:]:
        one = wrapper.align(one, wrapper.expression(p))
    for k, p in enumerate(pages):
        text = wrapper.page_text(p, one)
        assert "Constant" not in text and f"own{k}x399" in text


def test_alignment_drops_no_node():
    a, b = ([[f"div.{side}{i}", False, False, [], None] for i in range(300)] for side in "ab")
    assert len(wrapper.align(a, b)) == 600
