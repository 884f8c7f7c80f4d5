"""The package's own names."""

import pytest

import lexweave


def test_public_names():
    for name in lexweave.__all__:
        assert getattr(lexweave, name).__name__ == name and name in dir(lexweave)
    with pytest.raises(AttributeError):
        lexweave.nothing
