import pytest

from strandwork.llm import op6_html


@pytest.mark.parametrize("depth", [10, 119, 500, 20_000])
def test_hidden_elements_and_end_tags_at_any_depth(depth):
    inner = "<div style='display:none'>no<div>no</div>no</div><template>no</template><ul><li>in<li hidden>no<li>two</ul>"
    page = "<section>top" + "<div>" * depth + inner + "</div>" * depth + "end</section><b>after</b>"
    assert op6_html.render(page)[0] == "top\n\n- in\n- two\n\nend\nafter"
    assert op6_html.render("<i hidden>" + "<span>" * depth + "<i>no</i>no" + "</span>" * depth + "no</i>yes")[0] == "yes"


@pytest.mark.parametrize("tags", [("<table><tr><td>", "</td></tr></table>"), ("<ul><li>", "</li></ul>"), ("<blockquote>", "</blockquote>")])
def test_deep_layouts_keep_all_words(tags):
    assert "word" in op6_html.render(tags[0] * 400 + "word" + tags[1] * 400 + "<p hidden>no")[0]


def test_formulas_and_labels_of_figures_are_visible():
    page = "<p>so <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> <svg><title>no</title><defs><text>no</text></defs><g><path/><text>axis <tspan>x</tspan></text></g><text>y</text></svg></p>"
    assert op6_html.render(page)[0].split() == ["so", "a=2", "axis", "x", "y"]


def test_cells_after_a_wide_one_are_aligned():
    wide, long = " ".join(f"word{i}" for i in range(30)), "x" * 80
    for cell in (wide, long):
        lines = op6_html.render(f"<table><tr><td>{cell}<td>one<tr><td>b<td>two</table>")[0].split("\n")
        assert lines[0].index("one") == lines[-1].index("two")
        assert " ".join(lines).replace("one", "").split()[:-2] == cell.split()
