from hypothesis import given, settings
from hypothesis import strategies as st

from tuneweave.operators.order import split_bounds


@given(st.lists(st.integers(min_value=0, max_value=20), min_size=1, max_size=6).filter(lambda w: sum(w) > 0),
       st.integers(min_value=0, max_value=10_000))
@settings(max_examples=300, deadline=None)
def test_split_bounds_properties(weights, n):
    spec = ",".join(map(str, weights))
    try:
        b = split_bounds(spec, n)
    except ValueError:
        return  # the reference would produce overlapping parts here (D3)
    assert b[0] == 0 and b[-1] == n
    assert all(x <= y for x, y in zip(b, b[1:]))
    assert len(b) == len(weights) + 1
