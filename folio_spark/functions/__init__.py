"""Column functions: every one takes and returns columns, without Python on the executors."""
