"""Software inventories on Spark: manifests in, component and edge tables, SBOM documents and reports out."""
