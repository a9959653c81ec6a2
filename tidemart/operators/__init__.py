"""DataFrame -> DataFrame transforms; none of them reads or writes anything."""
