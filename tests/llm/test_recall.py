"""Recall of near-duplicates: every document whose id is divisible by 50 against all documents of sf0.1."""

import re
from collections import Counter, defaultdict

from matchloom.llm.neardup import op10_near_duplicates

BASE = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_near_duplicates_find_all_similar_pairs_of_the_query_set(spark):
    docs = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").toLocalIterator()}
    queries = [d for d in docs if d % 50 == 0]
    wanted = {s for d in queries for s in docs[d]}
    holders = defaultdict(list)
    for d, bag in docs.items():
        for s in bag.keys() & wanted:
            holders[s].append(d)
    pairs = set()
    for q in queries:
        common = Counter()
        for s, n in docs[q].items():
            for d in holders[s]:
                common[d] += min(n, docs[d][s])
        total = sum(docs[q].values())
        pairs |= {(q, d) for d, n in common.items() if d != q and n >= 0.8 * (total + sum(docs[d].values()) - n)}
    kind = {r.doc_id: r.class_id for r in op10_near_duplicates(spark, BASE).collect()}
    found = sum(kind[a] == kind[b] for a, b in pairs)
    print(found, "of", len(pairs))
    assert len(kind) == len(docs) and len(pairs) >= 50 and found == len(pairs)
