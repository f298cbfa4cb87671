import numpy as np

from wirebook.llm import near_dup


def plain(found: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Shingle and t of each draw by the formula, one draw after another."""
    r_of, c_of, beta_of = near_dup._tables()
    rows = [((found >> np.uint64(bits)) & np.uint64(near_dup.TABLE - 1)).astype(np.int64) for bits in (0, 14, 28)]
    out = []
    for draw in range(near_dup.BANDS * near_dup.DRAWS):
        r, c, beta = r_of[rows[0], draw], c_of[rows[1], draw], beta_of[rows[2], draw]
        t = np.floor(np.log(weights).astype(np.float32) / r + beta)
        least = int((c - r * (t - beta) - r).argmin())
        out.append((int(found[least]), int(t[least])))
    return out


def made(draw: np.random.Generator, n: int, other: float) -> tuple[np.ndarray, np.ndarray]:
    found = np.unique(draw.integers(1, 1 << 63, n).astype(np.uint64))
    return found, np.where(draw.random(len(found)) < other, draw.uniform(0.35, 40, len(found)), 1.0)


def test_draws_are_those_of_the_formula():
    """op10: short and long bags, weights of 1, others and both; the bands' keys follow from the draws alone."""
    draw = np.random.default_rng(17)
    bags = [made(draw, n, other) for n in (1, 2, 40, near_dup.RUN, near_dup.RUN + 1, 3 * near_dup.RUN) for other in (0, 0.02, 0.5, 1)]
    same = np.full(70, bags[2][0][0], np.uint64)  # equal ones: the first counts
    bags.append((same, np.ones(70)))
    keys = near_dup.bands(iter(bags))
    assert keys.shape == (len(bags), near_dup.BANDS) and keys.dtype == np.int64
    room = np.empty((3, 64, near_dup.BANDS * near_dup.DRAWS), np.float32)
    for own, bag in zip(keys, bags, strict=True):
        shingle, t = near_dup.draws(*bag, room)
        assert [(int(s), int(x)) for s, x in zip(shingle, t, strict=True)] == plain(*bag)
        assert (near_dup.bands([bag])[0] == own).all()
    assert near_dup.bands([]).shape == (0, near_dup.BANDS)


def test_shingles_that_weigh_1_take_no_logarithms(monkeypatch):
    """op10: t is worked out for the few shingles that don't weigh 1, not for all in every draw."""
    looked_at = []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def floor(self, x):
            looked_at.append(np.size(x))
            return np.floor(x)

    found, weights = made(np.random.default_rng(23), 5_000, 0.02)
    near_dup._tables()
    monkeypatch.setattr(near_dup, "np", Counted())
    near_dup.bands([(found, weights)])
    assert sum(looked_at) <= near_dup.BANDS * near_dup.DRAWS * ((weights != 1).sum() + 1)
