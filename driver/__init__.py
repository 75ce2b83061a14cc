"""The test tables seen as the library's tables, the registered queries and their SQL."""
