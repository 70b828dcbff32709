import logging

import pytest

from tracelake import api
from tracelake.errors import LimitError

LEVELS = ["trace", "debug", "info", "warning", "error", "critical"]


@pytest.mark.parametrize("level", [*LEVELS, "off"])
def test_levels(level, tmp_path):
    path = tmp_path / "a" / "log.txt"
    with api.logged("file", level, str(path)):
        for x in LEVELS:
            api.message(x, f"said {x}")
    text = path.read_text() if path.exists() else ""
    kept = LEVELS[LEVELS.index(level) :] if level != "off" else []
    assert [x for x in LEVELS if f"said {x}\n" in text] == kept


def test_messages_of_the_package(tmp_path):
    with api.logged("file", "warning", str(tmp_path / "log.txt")):
        logging.getLogger("tracelake.sources.container").warning("odd")
    assert "odd" in (tmp_path / "log.txt").read_text()


def test_standard_streams(capsys):
    with api.logged("console", "info"):
        api.message("info", "out")
    with api.logged("visual studio", "info"):
        api.message("info", "err")
    told = capsys.readouterr()
    assert "out" in told.out and "err" in told.err and "err" not in told.out


def test_unknown_names_change_nothing():
    log = logging.getLogger("tracelake")
    before = (list(log.handlers), log.level, log.propagate)
    for kind, level in (("paper", "info"), ("console", "loud")):
        with pytest.raises(LimitError):
            api.set_logger(kind, level)
        with pytest.raises(LimitError), api.logged(kind, level):
            pass
    with pytest.raises(LimitError):
        api.message("off", "x")
    assert (list(log.handlers), log.level, log.propagate) == before
