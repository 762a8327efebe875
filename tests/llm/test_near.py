"""Groups whose parts are linked through others, and ids on several rows."""

import random
from citemill.llm import minhash
from tests.llm import brute
def test_chain_and_far(spark):
    rng = random.Random(9)
    rows=[]
    base=[f"w{rng.randrange(10**6)}" for _ in range(150)]
    # groups of near copies drifting, all sharing most words
    i=0
    for g in range(6):
        w=list(base)
        for p in range(g*20, g*20+20+10): w[p%150]=f"g{g}_{p}"
        for _ in range(40):
            v=list(w)
            for _ in range(rng.randint(0,6)): v[rng.randrange(150)]=f"z{rng.randrange(10**6)}"
            rows.append((i," ".join(v))); i+=1
    rng.shuffle(rows)
    got={r.doc_id:r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows,"doc_id long, text string").repartition(7)).collect()}
    want={k:c for k,(_,c) in brute.components(rows).items()}
    print(len(set(want.values())))
    assert got==want
def test_ids(spark):
    A="a b c d e f g h i j"; B="k l m n o p q r s t"
    rows=[(3,A),(7,A),(7,B),(9,B),(11,None),(11,"x y"),(4,"x y"),(12,None),(12,None)]
    d=spark.createDataFrame(rows,"doc_id long, text string")
    got=sorted((r.doc_id,r.n_shingles,r.component_id,r.kept) for r in minhash.near_duplicates(d).collect())
    assert got==sorted([(3,6,3,True),(7,6,3,False),(7,6,3,False),(9,6,3,False),(11,0,4,False),(11,1,4,False),(4,1,4,True),(12,0,12,True),(12,0,12,True)])
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(d).collect())==[3,4,12,12]
