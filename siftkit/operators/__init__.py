"""DataFrame -> DataFrame operators (one function per survey operator)."""
