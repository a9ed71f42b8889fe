import random

from lodestar.operators import clustering as C


def slow(vectors, threshold, least):
    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    n = len(vectors)
    near = [[j for j in range(n) if j != i and round(cos(vectors[i], vectors[j]), 12) >= threshold] for i in range(n)]
    core = [len(x) >= least for x in near]
    root = {}
    for i in range(n):
        if core[i] and i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += [j for j in near[k] if core[j]]
    number = {r: k + 1 for k, r in enumerate(sorted(set(root.values())))}
    return [number[root[i]] if i in root else min((number[root[j]] for j in near[i] if core[j]), default=-1) for i in range(n)]


def test_degrees_above_a_hundred(spark):
    """Hubs with over 100 neighbours, equal or not, whose farthest neighbours join clusters; alone, zero and border rows."""
    rnd = random.Random(4)
    vectors = [[1.0, 0.0, 0.0, 0.0] for _ in range(130)]
    vectors += [[1.0, rnd.uniform(0.0, 0.001), 0.0, 0.0] for _ in range(120)]
    vectors += [[1.0, 1.4, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]]
    vectors += [[0.0, 0.0, 1.0, 1.0]] * 4 + [[0.0, 0.0, -1.0, 0.0]] * 3
    rnd.shuffle(vectors)
    vectors.insert(0, [1.0, 0.6, 0.0, 0.0])  # the farthest of all its neighbours has the smallest id
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(4)
    given = [r.embedding for r in df.orderBy("vec_id").collect()]
    got = {r.id: r.cluster for r in C.cluster_vectors(df, 0.85, 3).collect()}
    assert [got[i] for i in range(len(given))] == slow(given, 0.85, 3)
