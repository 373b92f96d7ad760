"""Column functions: keys, labels, time codes and vectors."""
