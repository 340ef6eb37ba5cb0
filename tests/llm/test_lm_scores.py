import math
from collections import Counter

import pytest
from samples import collected, docs, none, odd, odd_rows  # noqa: F401

from washboard.llm.lm_scores import lm_scores
from washboard.llm.tokens import ids


def plain(texts, order, leave_out):
    encoded = [ids().encode(t or "").tolist() for t in texts]

    def grams(e):
        return Counter(tuple(e[i : i + n]) for n in range(1, order + 1) for i in range(len(e) - n + 1))

    totals, out = Counter(), []
    for e in encoded:
        totals.update(grams(e))
    everything = sum(map(len, encoded))
    for e in encoded:
        own = grams(e) if leave_out else Counter()
        score, used = 0.0, [0] * order
        for j in range(len(e)):
            factor = 0.0
            for n in range(min(order, j + 1), 0, -1):
                gram = tuple(e[j - n + 1 : j + 1])
                seen = totals[gram] - own[gram]
                if n == 1:
                    score += factor + math.log(max(seen, 0.5) / max(everything - (len(e) if leave_out else 0), 1))
                elif seen > 0:
                    score += factor + math.log(seen / (totals[gram[:-1]] - own[gram[:-1]]))
                else:
                    factor += math.log(0.4)
                    continue
                used[n - 1] += 1
                break
        out.append((len(e), score, used))
    return out


@pytest.mark.parametrize("order, leave_out", [(3, True), (3, False), (2, True), (1, True)])
def test_scores(docs, order, leave_out):
    rows = docs.filter("doc_id < 60").select("doc_id", "text").collect()
    got = {g["doc_id"]: g for g in collected(lm_scores(docs.filter("doc_id < 60").repartition(3), order=order, leave_out=leave_out, block_tokens=5000, part_bytes=20_000))}
    for r, (n, score, used) in zip(rows, plain([r["text"] for r in rows], order, leave_out)):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["orders"]) == (n, used)
        assert g["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_odd_rows(odd, none):
    got = collected(lm_scores(odd))
    assert len(got) == len(odd_rows())
    expected = Counter((r[0], n, round(s, 6)) for r, (n, s, _) in zip(odd_rows(), plain([r[1] for r in odd_rows()], 3, True)))
    assert Counter((g["doc_id"], g["n_tokens"], round(g["log_score"], 6)) for g in got) == expected
    assert all((g["mean_log_score"] is None) == (g["n_tokens"] == 0) for g in got)
    assert lm_scores(none).count() == 0
    with pytest.raises(ValueError):
        lm_scores(odd, order=4)
