"""Edit logs with undo against a plain stack of snapshots."""

import copy
import random

from trackmill.operators import edits


class Editor:
    """Fragments of one session and a stack of their earlier states; refused edits leave no trace."""

    def __init__(self, lanes):
        self.lanes = {f: [t, a, b, False] for f, t, a, b in lanes}
        self.next, self.past, self.log = max(self.lanes) + 1, [], []

    def edit(self, op, frag=None, at=None, to=None):
        if op == "undo":
            if self.past:
                self.lanes = self.past.pop()
            self.log.append((op, None, None, None))
            return
        own = self.lanes.get(frag)
        if own is None or own[3] or (op == "split" and not own[1] < at <= own[2]) or (op == "reassign" and own[0] == to):
            return
        self.past.append(copy.deepcopy(self.lanes))
        if op == "split":
            self.lanes[self.next] = [own[0], at, own[2], False]
            own[2] = at - 1
            self.next += 1
        elif op == "delete":
            own[3] = True
        else:
            own[0] = to
        self.log.append((op, frag, at, to))


def run(spark, sessions):
    lanes = [(s, f, *v) for s, (start, _) in sessions.items() for f, *v in start]
    logs = [(s, k, *e) for s, (_, editor) in sessions.items() for k, e in enumerate(editor.log)]
    found = edits.replay(spark.createDataFrame(lanes, "Session string, FragID long, TrackID long, F0 long, F1 long"), spark.createDataFrame(logs, "Session string, Seq long, Op string, FragID long, At long, ToID long"))
    want = {(s, f, *v) for s, (_, editor) in sessions.items() for f, v in editor.lanes.items()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_random_logs_equal_a_stack(spark):
    draw, sessions = random.Random(12), {}
    for s in range(40):
        start = [(f, f % 3, 10 * f, 10 * f + draw.randrange(30)) for f in range(draw.randrange(1, 5))]
        editor = Editor(start)
        for _ in range(draw.randrange(60)):
            op = draw.choices(("split", "delete", "reassign", "undo"), (6, 1, 3, 4))[0]
            editor.edit(op, draw.randrange(editor.next), draw.randrange(60), draw.randrange(5))
        sessions[f"s{s}"] = (start, editor)
    assert sum(any(e[0] == "undo" for e in ed.log) for _, ed in sessions.values()) > 20
    run(spark, sessions)


def test_nested_splits_and_empty_logs(spark):
    start = [(0, 7, 0, 100)]
    deep, idle, undone = Editor(start), Editor(start), Editor(start)
    for k in range(1, 12):
        deep.edit("split", k - 1, 8 * k, None)
    deep.edit("reassign", 3, None, 9)
    deep.edit("undo")
    deep.edit("split", 5, 44, None)
    for _ in range(3):
        undone.edit("undo")
    undone.edit("split", 0, 50, None)
    undone.edit("undo")
    undone.edit("split", 0, 60, None)
    assert set(undone.lanes) == {0, 2}
    run(spark, {"deep": (start, deep), "idle": (start, idle), "undone": (start, undone)})


def test_edits_that_no_longer_fit_change_nothing(spark):
    lanes = spark.createDataFrame([("s", 0, 1, 0, 9)], "Session string, FragID long, TrackID long, F0 long, F1 long")
    log = [("s", 0, "split", 0, 0, None), ("s", 1, "split", 0, 50, None), ("s", 2, "split", 0, 5, None), ("s", 3, "split", 0, 7, None), ("s", 4, "delete", 0, None, None), ("s", 5, "reassign", 0, None, 4), ("s", 6, "split", 9, 3, None)]
    found = edits.replay(lanes, spark.createDataFrame(log, "Session string, Seq long, Op string, FragID long, At long, ToID long"))
    assert {tuple(r) for r in found.collect()} == {("s", 0, 1, 0, 4, True), ("s", 3, 1, 5, 9, False)}
    assert edits.replay(lanes.limit(0), spark.createDataFrame(log, "Session string, Seq long, Op string, FragID long, At long, ToID long")).collect() == []
