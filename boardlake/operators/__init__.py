"""DataFrame operators: lazy, declarative, no actions inside unless stated."""
