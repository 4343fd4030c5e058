from skewlens.cli import main

raise SystemExit(main())
