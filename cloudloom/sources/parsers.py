"""Parsers of point-cloud, mesh and result files: bytes in, columns out.  Lines that don't parse are left out."""

from __future__ import annotations

import re

import numpy as np

Table = dict[str, list | np.ndarray]


def _rows(lines: list[bytes], widths: tuple[int, ...]) -> list[list[float]]:
    """The numbers of each line that has one of the given counts of them."""
    out = []
    for line in lines:
        parts = line.split()
        if len(parts) in widths:
            try:
                out.append([float(p) for p in parts])
            except ValueError:
                continue
    return out


def _header(raw: bytes, last: bytes) -> tuple[dict[str, list[str]], bytes]:
    """Keyword lines up to the one that begins with ``last``, and the rest."""
    head: dict[str, list[str]] = {}
    at = 0
    while at < len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        line = raw[at:end].strip()
        at = end + 1
        parts = line.decode("latin-1").split()
        if parts and not line.startswith(b"#"):
            head[parts[0]] = parts[1:]
        if line.startswith(last):
            break
    return head, raw[at:]


def pcd(raw: bytes) -> Table:
    """x, y, z and rgb (packed, null if there is none) from ascii or raw float32 bodies; ``binary_compressed`` means raw quadruples here, so a compressed body is refused."""
    head, body = _header(raw, b"DATA")
    fields = head.get("FIELDS", ["x", "y", "z"])
    n = int(head.get("POINTS", ["0"])[0])
    kind = head.get("DATA", ["ascii"])[0]
    if kind == "ascii":
        rows = _rows(body.splitlines(), (3, 4, *range(5, 64)))
        a = [r[:4] + [np.nan] * (4 - len(r[:4])) for r in rows]
        xyz = np.array(a, float).reshape(-1, 4)
        coloured = len(fields) > 3 and fields[3] in ("rgb", "rgba")
    else:
        width = 4 if kind == "binary_compressed" else len(fields)
        if len(body) < 4 * width * n:
            raise ValueError("the body is shorter than POINTS says; compressed bodies aren't supported")
        a = np.frombuffer(body, "<f4", width * n).reshape(n, width)
        xyz = np.full((n, 4), np.nan)
        xyz[:, : min(width, 4)] = a[:, :4]
        coloured = width > 3
    rgb = [int(v) if coloured and v == v else None for v in xyz[:, 3]]
    return {"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "rgb": rgb}


def kitti(raw: bytes) -> Table:
    a = np.frombuffer(raw, "<f4", len(raw) // 16 * 4).reshape(-1, 4).astype(float)
    return {"pid": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "reflectance": a[:, 3]}


def oxts(raw: bytes) -> Table:
    rows = _rows(raw.splitlines()[:1], tuple(range(6, 64)))
    return {k: [r[i] for r in rows] for i, k in enumerate(("lat", "lon", "alt", "roll", "pitch", "yaw"))}


def pts(raw: bytes) -> Table:
    """Blocks of a count line and rows of x y z intensity [r g b]."""
    rows = _rows(raw.splitlines(), (4, 7))
    full = [r + [np.nan] * (7 - len(r)) for r in rows]
    out: Table = {"pid": np.arange(len(full))}
    out |= {k: [r[i] for r in full] for i, k in enumerate(("x", "y", "z", "intensity"))}
    out |= {k: [int(r[i]) if r[i] == r[i] else None for r in full] for i, k in ((4, "r"), (5, "g"), (6, "b"))}
    return out


def _ply(raw: bytes) -> tuple[int, int, list[bytes]]:
    head = raw[: raw.find(b"end_header")].decode("latin-1")
    n = {k: int(v) for k, v in re.findall(r"element\s+(\w+)\s+(\d+)", head)}
    return n.get("vertex", 0), n.get("face", 0), raw[raw.find(b"end_header") :].splitlines()[1:]


def ply_points(raw: bytes) -> Table:
    """Vertices with colours, white where there are none."""
    n, _, lines = _ply(raw)
    rows = [r[:6] if len(r) >= 6 else r[:3] + [255.0] * 3 for r in _rows(lines[:n], tuple(range(3, 64)))]
    out: Table = {"pid": np.arange(len(rows))}
    out |= {k: [r[i] for r in rows] for i, k in enumerate("xyz")}
    return out | {k: [int(r[i]) for r in rows] for i, k in ((3, "r"), (4, "g"), (5, "b"))}


def ply_faces(raw: bytes) -> Table:
    """Triangles, with vertices counted from 0."""
    n, m, lines = _ply(raw)
    rows = [r[1:4] for r in _rows(lines[n : n + m], tuple(range(4, 64))) if r[0] == 3]
    return {"fid": np.arange(len(rows)), **{k: [int(r[i]) for r in rows] for i, k in enumerate("abc")}}


def _obj(raw: bytes):
    """Vertices; triangles with their group and material, vertices counted from 0."""
    vertices, faces, group, material = [], [], "", ""
    for line in raw.decode("utf-8", "replace").splitlines():
        p = line.split()
        if not p:
            continue
        if p[0] == "v" and len(p) >= 4:
            vertices.append([float(v) for v in p[1:4]])
        elif p[0] == "g":
            group = " ".join(p[1:])
        elif p[0] == "usemtl":
            material = " ".join(p[1:])
        elif p[0] == "f" and len(p) >= 4:
            faces.append([int(v.split("/")[0]) - 1 for v in p[1:4]] + [group, material])
    return vertices, faces


def obj_points(raw: bytes) -> Table:
    v, _ = _obj(raw)
    return {"pid": np.arange(len(v)), **{k: [r[i] for r in v] for i, k in enumerate("xyz")}}


def obj_faces(raw: bytes) -> Table:
    _, f = _obj(raw)
    return {"fid": np.arange(len(f)), **{k: [r[i] for r in f] for i, k in enumerate(("a", "b", "c", "grp", "material"))}}


def obj_elements(raw: bytes) -> Table:
    """The distinct vertices of each material group."""
    v, f = _obj(raw)
    seen = list(dict.fromkeys((r[4], i) for r in f for i in r[:3] if i < len(v)))
    return {"element": [m for m, _ in seen], "vid": [i for _, i in seen], **{k: [v[i][j] for _, i in seen] for j, k in enumerate("xyz")}}


def off_points(raw: bytes) -> Table:
    lines = [x for x in raw.splitlines() if x.strip() and not x.startswith(b"#")]
    n = int(lines[1].split()[0]) if len(lines) > 1 else 0
    rows = _rows(lines[2 : 2 + n], (3,))
    return {"pid": np.arange(len(rows)), **{k: [r[i] for r in rows] for i, k in enumerate("xyz")}}


def matrix(raw: bytes) -> Table:
    """Rows of a nested {..} list; signs count."""
    rows = [[float(v) for v in re.findall(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", r)] for r in re.findall(r"\{([^{}]*)\}", raw.decode("latin-1"))]
    return {"row": np.arange(len(rows)), "features": rows}


def descriptor(raw: bytes) -> Table:
    """Rows of COUNT numbers after the header."""
    head, body = _header(raw, b"DATA")
    d = int(head.get("COUNT", ["0"])[0])
    rows = _rows(body.splitlines(), (d,)) if d else []
    return {"desc_id": np.arange(len(rows)), "features": rows}


def occupancy_grid(raw: bytes) -> Table:
    """Cells with a value, by index x + y L + z L W, over the largest value."""
    numbers = [float(v) for v in raw.split()]
    w, h = int(numbers[0]), int(numbers[1])
    v = np.array(numbers[3:])
    at = np.flatnonzero(v)
    top = v.max(initial=0) or 1.0
    return {"x": at % w, "y": at // w % h, "z": at // (w * h), "v": v[at] / top}


def labels(raw: bytes) -> Table:
    """One whole number a line; the line is the object."""
    rows = _rows(raw.splitlines(), (1,))
    return {"obj_id": np.arange(len(rows)), "label": [int(r[0]) for r in rows]}


def prediction(raw: bytes) -> Table:
    """Lines of a class and scores; with a header ``labels c1 c2 ..`` the scores' classes."""
    lines = raw.decode().splitlines()
    classes = [int(c) for c in lines[0].split()[1:]] if lines and lines[0].startswith("labels") else None
    rows = _rows([x.encode() for x in (lines[1:] if classes else lines)], tuple(range(1, 4096)))
    return {"obj_id": np.arange(len(rows)), "label": [int(r[0]) for r in rows], "scores": [[{"label": c, "score": v} for c, v in zip(classes or range(1, len(r)), r[1:], strict=False)] for r in rows]}


def categories(raw: bytes) -> Table:
    """``id: name`` lines."""
    rows = [x.split(":", 1) for x in raw.decode().splitlines() if re.match(r"\s*[0-9]+\s*:", x)]
    return {"label": [int(a) for a, _ in rows], "name": [b.strip() for _, b in rows]}


def shape_classes(raw: bytes) -> Table:
    """``name parent count`` lines, each followed by that many model ids."""
    name, left, out = "", 0, []
    for line in raw.decode().splitlines()[2 if raw.startswith(b"PSB") else 0 :]:
        p = line.split()
        if len(p) == 3 and p[2].isdigit() and not left:
            name, left = p[0], int(p[2])
        elif len(p) == 1 and left and p[0].isdigit():
            out.append((name, int(p[0])))
            left -= 1
    return {"category": [a for a, _ in out], "model_id": [b for _, b in out]}


def matches(raw: bytes) -> Table:
    """Lines of a file and ``x,y,z`` or ``null``: one row a token."""
    out = []
    for scan, line in enumerate(x for x in raw.decode().splitlines() if x.strip()):
        p = line.split()
        for k, v in enumerate(p[1:]):
            xyz = [float(n) for n in v.split(",")] if v != "null" else [None] * 3
            out.append((scan, p[0], k, *xyz))
    return {c: [r[i] for r in out] for i, c in enumerate(("scan", "file", "k", "x", "y", "z"))}


def bitmap(raw: bytes) -> Table:
    """Set pixels of a plain bitmap."""
    body = b" ".join(x.split(b"#")[0] for x in raw.splitlines()).split()
    w, h = int(body[1]), int(body[2])
    bits = np.frombuffer(b"".join(body[3:]), np.uint8)[: w * h] == ord("1")
    at = np.flatnonzero(bits)
    return {"xi": at % w, "yi": at // w}


def pixmap(raw: bytes) -> Table:
    """Pixels of a raw 8-bit gray or colour map."""
    head = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", raw)
    w, h, depth = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
    a = np.frombuffer(raw, np.uint8, w * h * depth, head.end()).reshape(-1, depth).astype(int)
    at = np.arange(w * h)
    return {"xi": at % w, "yi": at // w, "r": a[:, 0], "g": a[:, depth // 2], "b": a[:, depth - 1]}


def _bundler(raw: bytes):
    t = iter(x for line in raw.decode().splitlines() if not line.startswith("#") for x in line.split())
    num = lambda n: [float(next(t)) for _ in range(n)]
    cameras, points = (int(v) for v in num(2))
    cams = [num(15) for _ in range(cameras)]
    pts_, views = [], []
    for k in range(points):
        pts_.append(num(6))
        for _ in range(int(next(t))):
            v = num(4)
            views.append((k, int(v[0]), int(v[1]), v[2], v[3]))
    return cams, pts_, views


def bundler_cameras(raw: bytes) -> Table:
    cams, _, _ = _bundler(raw)
    return {"camera": np.arange(len(cams)), "focal": [c[0] for c in cams], "k1": [c[1] for c in cams], "k2": [c[2] for c in cams], "rotation": [c[3:12] for c in cams], "shift": [c[12:] for c in cams]}


def bundler_points(raw: bytes) -> Table:
    _, p, _ = _bundler(raw)
    return {"pid": np.arange(len(p)), **{k: [r[i] for r in p] for i, k in enumerate("xyz")}, **{k: [int(r[i]) for r in p] for i, k in ((3, "r"), (4, "g"), (5, "b"))}}


def bundler_views(raw: bytes) -> Table:
    _, _, v = _bundler(raw)
    return {c: [r[i] for r in v] for i, c in enumerate(("pid", "camera", "key", "u", "v"))}


def projection(raw: bytes) -> Table:
    """Rotation, shift and centre from a 3 x 4 projection with a known focal length (600 on 640 x 480)."""
    text = raw.decode("latin-1").strip()
    if not text.startswith("CONTOUR"):
        return {"rotation": [], "shift": [], "centre": []}
    p = np.array([float(v) for v in text.split()[1:13]]).reshape(3, 4)
    k = np.array([[600.0, 0, 320], [0, 600, 240], [0, 0, 1]])
    rt = np.linalg.solve(k, p)
    r, t = rt[:, :3], rt[:, 3]
    return {"rotation": [r.ravel().tolist()], "shift": [t.tolist()], "centre": [(-r.T @ t).tolist()]}
