"""Array stores."""
