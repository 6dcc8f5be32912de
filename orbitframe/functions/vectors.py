"""SQL expressions over three-vectors stored as columns <name>x, <name>y, <name>z."""

Vec = tuple[str, str, str]


def cols(prefix: str) -> Vec:
    return tuple(f"{prefix}{axis}" for axis in "xyz")


def named(vec: Vec, prefix: str) -> list[str]:
    """``expr AS name`` for each component."""
    return [f"{part} AS {prefix}{axis}" for axis, part in zip("xyz", vec)]


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})",
            f"({a[2]} * {b[0]} - {a[0]} * {b[2]})",
            f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def over(a: Vec, k: str) -> Vec:
    return tuple(f"({p} / {k})" for p in a)


def norm(a: Vec) -> str:
    return f"sqrt({dot(a, a)})"
