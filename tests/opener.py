"""A store that neither Spark nor open() reaches: vault://some/path is /some/path of this machine."""

from pyarrow import fs


def vault(uri):
    return fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("vault://")


def pages(content):
    """A renderer for tests: a document is lines `signal height|text`, one for each page; other documents can't be read."""
    import numpy as np

    out = []
    for line in bytes(content).decode().split("\f"):
        heights, text = line.split("|", 1)
        page = np.full((400, 1700, 3), 255, np.uint8)
        page[260:334, 220:700] = 100
        page[260:334, 1000:1600] = 100
        for i, (x, h) in enumerate(zip((240, 500, 1100, 1300), map(int, heights.split()), strict=True)):
            page[334 - h : 334, x : x + 10 + i] = 171
        for at in (400, 1200):
            page[250:334, at : at + 2] = (255, 0, 0)
        out.append((page, text))
    return out


def model():
    """A protein model for tests: a residue's vector is told by its letter; places behind a sequence hold junk."""
    import numpy as np

    def run(sequences):
        longest = max(map(len, sequences), default=0)
        out = np.full((len(sequences), longest + 2, 7), 99.0, np.float32)
        for i, s in enumerate(sequences):
            for j, c in enumerate(s):
                out[i, j + 1] = [ord(c) % m for m in (2, 3, 5, 7, 11, 13, 17)]
        return out

    return run
