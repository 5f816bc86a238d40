"""Generic DataFrame operators. None of them assumes evenly filled keys."""
