"""Column-expression helpers: pure ``Column -> Column`` functions that stay inside codegen."""
