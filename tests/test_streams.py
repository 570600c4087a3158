"""Commands to animations, as a stream in several batches against plain Python and the finished table."""

import json
import os


from arclet.streaming import commands as C

SCHEMA = "session string, seq long, command string, a double, b double"


def session(name, rows):
    return [(name, seq, *(list(r) + [None] * 3)[:3]) for seq, r in enumerate(rows)]


COMMANDS = [
    *session("one", [("place", 1.0, 2.0), ("velocity", 0.5, -0.25), ("step",), ("step", 3.0), ("time", 10.0), ("show",), ("radius", 0.25), ("show",), ("place", 0.0, 0.0), ("step", 2.0)]),
    *session("two", [("step",), ("dance", 1.0), (None,), ("velocity", 1.0, 1.0), ("step",), ("step", 0.0), ("show",)]),
    (None, 0, "show", None, None),
]


def plain(rows, dt=0.1):
    x = y = vx = vy = t = 0.0
    radius, out = 1.0, []
    for _, seq, command, a, b in rows:
        shows = {"place": 1, "show": 1, "step": 1 if a is None else int(a or 0)}.get(command, 0)
        if command == "place":
            x, y, t = a, b, 0.0
        elif command == "time":
            t = a
        elif command == "velocity":
            vx, vy = a, b
        elif command == "radius":
            radius = a
        for _ in range(shows):
            t += dt * (command == "step")
            out.append((seq, len(out), t, x + vx * t, y + vy * t, radius))
    return out


def test_a_stream_in_batches_shows_what_the_table_does(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    names = SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")

    def put(k, rows):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        # Files come in the order of their times.
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        C.frames_of(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(sink)).awaitTermination()

    put(0, COMMANDS[:4] + COMMANDS[10:12])
    put(1, COMMANDS[4:7])
    run()
    # The stream stops here; what each session has done stays.
    put(2, COMMANDS[7:10] + COMMANDS[12:])
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(sink)).collect())
    table = C.frames_of_table(spark.createDataFrame(COMMANDS, SCHEMA).repartition(3))
    assert got == sorted(tuple(r) for r in table.collect())
    for name in ("one", "two"):
        assert [r[1:] for r in got if r[0] == name] == plain([c for c in COMMANDS if c[0] == name])
    assert len(got) == 13
