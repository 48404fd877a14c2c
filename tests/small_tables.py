"""The smallest of the tables that come with the task."""

SMALL = "/root/testdata/sf0.001"
