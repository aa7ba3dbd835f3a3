import math
from collections import Counter

import pytest

from quern.llm import lm_backoff


def brute(texts, order, alpha):
    """[(doc_id, words, seen, score)] from counters over all texts and over each alone."""
    docs = [(d, ["<s>", *(t or "").encode().lower().split()]) for d, t in texts]

    def counted(words):
        return Counter(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1) if n > 1 or i > 0)

    whole = sum((counted(w) for _, w in docs), Counter())
    total, texts = sum(len(w) - 1 for _, w in docs), sum(1 for _, w in docs if len(w) > 1)
    out = []
    for d, words in docs:
        own = counted(words)
        left = lambda g: whole[g] - own[g] if g != ("<s>",) else texts - 1
        seen, score = 0, 0.0
        for i in range(1, len(words)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(words[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(factor * max(left(gram), 1) / total)
                elif left(gram) > 0:
                    seen += n == min(order, i + 1)
                    score += math.log(factor * left(gram) / left(gram[:-1]))
                    break
                factor *= alpha
        out.append((d, len(words) - 1, seen, score))
    return out


@pytest.mark.parametrize("order,block", [(3, 1 << 21), (3, 50), (2, 1000), (4, 1000)])
def test_scores_equal_brute_force(odd, documents, order, block):
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text").limit(60))
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 3))
    want = sorted(brute([(r[0], r[1]) for r in docs.collect()], order, 0.4), key=key)
    got = sorted(map(tuple, lm_backoff.scores(docs, order, 0.4, block).collect()), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-9, abs=1e-9)


def test_clashing_columns_and_empty_table(odd, no_docs):
    assert lm_backoff.scores(odd).count() == odd.count()
    assert lm_backoff.scores(no_docs).count() == 0


def test_missing_column(odd):
    with pytest.raises(ValueError):
        lm_backoff.scores(odd.drop("text"))
