"""Finding F20: repeats of a name are numbered by what they have, not lined up again."""

from fotolake.operators import windows as wn


def test_only_repeats_before_a_number_are_lined_up(spark, monkeypatch):
    sizes = []
    plain = wn.prev_next

    def counted(frame, *args, **more):
        sizes.append(frame.count())
        return plain(frame, *args, **more)

    monkeypatch.setattr(wn, "prev_next", counted)
    rows = [(i, "f", "a (3).jpg" if i == 1 else "a.jpg") for i in range(300)]
    found = {r["id"]: r["unique"] for r in wn.unique_names(spark.createDataFrame(rows, "id long, folder string, name string")).collect()}
    want = {0: "a.jpg", 1: "a (3).jpg"} | {i: f"a ({i - 1 if i < 4 else i}).jpg" for i in range(2, 300)}
    assert found == want
    assert max(sizes) < 10
