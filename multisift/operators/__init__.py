"""DataFrame operators on count matrices in long form, cell tables, interval tables and neighbour lists."""
