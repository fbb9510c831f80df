"""Physical plans as text."""

import contextlib
import io


def plan_of(df, run=False):
    """Physical plan of a frame; the final adaptive one if it was run."""
    if run:
        df.collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue().split("== Initial Plan ==")[0]
