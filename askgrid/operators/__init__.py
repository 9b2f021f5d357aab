"""DataFrame operators built on the column builders."""
