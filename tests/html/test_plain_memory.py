"""Long documents of plain markup."""

import tracemalloc

from tagweave.operators import flatten, plain
from tagweave.operators.flatten import Columns


def items(n):
    return "<p>top</p><ul>" + "".join(f'<li id="p{i}" title="part {i} &amp; more" class="part k{i % 3}" data-key="{i}">part {i}</li>' for i in range(n)) + "</ul>"


def test_what_stands_in_memory_of_a_long_list(monkeypatch):
    monkeypatch.setattr(plain, "PIECE", 1 << 14, raising=False)
    monkeypatch.setattr(flatten, "AT_ONCE", 1 << 10, raising=False)
    html = items(20000)
    tracemalloc.start()
    rows = Columns((), ("norm", "type_idx_last", "attr_map"))
    assert rows.add_text(html)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 5 * len(html), peak / len(html)
    assert dict(rows.array()[0][-2]["attr_map"].as_py()) == {"id": "p19999", "title": "part 19999 & more", "class": "part k1", "data-key": "19999"}


def test_pieces_give_what_the_whole_gives(monkeypatch):
    names = ("pre", "parent", "last", "kind", "name", "attrs", "attr_map", "classes", "id_attr", "content", "text")

    def dom(html):
        rows = Columns(("text",), names)
        return rows.add_text(html), rows.array().to_pylist()

    texts = [items(50), "before" + items(3) + "after", '<p title="a<b">x</p>', "<p>a < b</p>", "<ul>" + "<li>x</li>" * 40 + "<li>", "<b>x</b>", "no tags", " <b>x</b>"]
    whole = [dom(t) for t in texts]
    for size in (1, 7, 60):
        monkeypatch.setattr(plain, "PIECE", size)
        assert [dom(t) for t in texts] == whole
    assert [w[0] for w in whole] == [True, True, False, False, False, True, False, False]
