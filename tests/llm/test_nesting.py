"""Problem 2: documents inside documents to any depth, and any number of equal signs."""

import html
from fractions import Fraction

from lexloom.llm import markup as M

PAGES = ["<p>a <b>bold</b> word</p>", "a **bold** word\n\n- one\n- two", "== Head ==\n[[go|went]]", "\\textbf{bold} and \\emph{word}", "plain words"] * 20
MODEL = M.train(PAGES)
INNER = "<p>see</p>\n\n- one\n- two\n\n**bold** word and **more**"


def test_deep_frames():
    for depth in (1, 5, 40):
        page = INNER
        for _ in range(depth):
            page = f'<iframe srcdoc="{html.escape(page)}"></iframe>'
        assert M.carried(page, MODEL) == ["html", "markdown"], depth
        got = M.clean(page, MODEL)
        assert "bold word and more" in got and "**" not in got, depth


def test_deep_escapes():
    page = INNER
    for _ in range(12):
        page = f"<p>x</p>{html.escape(page)}"
    assert M.carried(page, MODEL) == ["html", "markdown"]
    got = M.clean(page, MODEL)
    assert "bold word and more" in got and "<" not in got and "&" not in got


def test_deep_elements():
    page = "<div>" * 3000 + "word" + "</div>" * 3000
    assert M.carried(page, MODEL) == ["html"] and M.clean(page, MODEL) == "word"
    M.train([page])


def test_many_equal_leaves():
    """Marginals of a document over n equal leaves and one other, against exact fractions."""
    for n in (1, 8, 9, 30, 2000):
        root = M.Node("document")
        root.children = [M.Node("star item") for _ in range(n)] + [M.Node("wiki bold")]
        whole = lambda xs: [Fraction(x) for x in xs]
        edge, told = [whole(r) for r in MODEL.edge], {}
        for k in ("star item", "wiki bold"):
            told[k] = [sum(r[c] * Fraction(MODEL.emission[k][c]) for c in range(5)) for r in edge]
        own = [p * e * a**n * b for p, e, a, b in zip(whole(MODEL.prior), whole(MODEL.emission["document"]), told["star item"], told["wiki bold"])]
        want = [float(x / sum(own)) for x in own]
        got = next(m for kind, m in MODEL.marginals(root) if kind == "document")
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), n


def test_unclosed_tags():
    for tag in ("p", "li", "td", "tr", "i", "section", "font"):
        page = f"<{tag}>word " * 5000
        assert M.carried(page, MODEL) == ["html"] and M.clean(page, MODEL).count("word") == 5000, tag
    assert len(M._downwards(M.parse("<ul>" + "<li>a<p>b" * 50 + "</ul>"))) <= 102  # siblings, not one inside the other
    assert M.clean("<ul><li>a<li>b<p>c</ul><p>d<p>e", MODEL) == "- a\n- b\nc\n\nd\ne"
    assert M.clean("<table><tr><td>a<td>b<tr><td>c</table>", MODEL) == "| a | b |\n| c |"


def test_escaped_escapes():
    page = "<b>x</b>"
    for _ in range(8):
        page = html.escape(page)
        assert M.carried(page, MODEL) == ["html"] and M.clean(page, MODEL) == "x"


def test_code_and_formulas_stay():
    wiki, latex, markdown = "== Head ==\n'''w''' [[go|went]]\n", "\\textbf{b} \\emph{i}\n", "# Head\n\n**b** and *i*\n\n"
    assert "a = m[[0]] and {{x}}" in M.clean(wiki + "<pre>a = m[[0]] and {{x}}</pre>", MODEL)
    assert "$f''(x)+g''(x)=0$" in M.clean(wiki + "so $f''(x)+g''(x)=0$ holds", MODEL)
    assert "```\n\\textbf{keep} **all**\n\n\n  x  \n```" in M.clean(markdown + "```\n\\textbf{keep} **all**\n\n\n  x  \n```\n" + latex, MODEL)
    assert "&lt;b&gt;" not in M.clean("<pre>&lt;b&gt;x&lt;/b&gt;</pre>", MODEL) and "<b>x</b>" in M.clean("<pre>&lt;b&gt;x&lt;/b&gt;</pre>", MODEL)
    assert "a_b_c" in M.clean(markdown + "`a_b_c`", MODEL) and "x{1}" not in M.clean(latex + "\\verb", MODEL)
    assert "\\begin{equation}x_{1}\\end{equation}" in M.clean(latex + "\\begin{equation}x_{1}\\end{equation}", MODEL)
    assert "```\n\\emph{x}\n```" in M.clean(latex + "\\begin{verbatim}\n\\emph{x}\n\\end{verbatim}", MODEL)


def test_marginals_decide_node_by_node():
    """A sign whose label is content stays, in a text in which others go."""
    page = M.parse("'''w''' and [[x]]")
    labels = MODEL.labels(page)
    page_labels = {k: v for k, v in labels.items() if isinstance(k, tuple)}
    assert set(page_labels.values()) == {M.WIKI}
    labels[id(page), "wiki link"] = M.CONTENT
    assert M._draw(page, labels, {}) == "w and [[x]]"


def test_latex_structure():
    latex = "\\section{A \\emph{b}}\n\\subsection{C}\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\\begin{tabular}{ll}\n\\hline\na & b \\\\\nc & \\textbf{d} \\\\\n\\end{tabular}\nend\\footnote{note} \\href{http://x}{site}"
    assert M.clean(latex, MODEL) == "# A b\n## C\n- one\n- two\n| a | b |\n| c | d |\nend(note) site"
