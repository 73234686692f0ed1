"""Where the tests read their tables."""

DATA = "/root/testdata/sf0.001"
