"""A beam search of the graph measures a node once for each query."""

import numpy as np

from lectern.llm import graph


def test_no_node_is_measured_twice_for_a_query(monkeypatch):
    points = graph.lifted(np.random.default_rng(3).normal(size=(400, 12)))
    edges, entry = graph.build_graph(points)
    asked = points[:50]
    measured, plain = [], np.einsum

    def counted(form, *arrays):
        out = plain(form, *arrays)
        measured.append(out.size)
        return out

    monkeypatch.setattr(graph.np, "einsum", counted)
    ids, expanded = graph.beam_search(points, edges, asked, entry, 64)
    assert sum(measured) <= len(asked) * (len(points) - 1)
    monkeypatch.undo()
    away = ((asked[:, None, :] - points[None]) ** 2).sum(axis=2)
    for query, (found, nodes) in enumerate(zip(ids, expanded)):
        assert found[0] == query and len(set(found.tolist())) == 64 and (np.diff(away[query, found]) >= -1e-6).all()
        # All of the beam was expanded, each node once.
        assert set(found.tolist()) <= set(nodes) and len(set(nodes)) == len(nodes)
        assert len(set(np.argsort(away[query])[:20].tolist()) - set(found.tolist())) == 0
