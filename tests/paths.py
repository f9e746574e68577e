"""Places of the given tables; a plain module, since ``conftest`` may name another folder's."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
